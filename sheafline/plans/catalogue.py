"""All registered queries and their oracles."""

from __future__ import annotations

from sheafline.plans import docx, files, items, prepared, quizzes, reports, sequences, streams, trees, values

QUERIES: dict = {**items.QUERIES, **sequences.QUERIES, **quizzes.QUERIES, **files.QUERIES, **streams.QUERIES, **prepared.QUERIES, **trees.QUERIES, **docx.QUERIES, **reports.QUERIES, **values.QUERIES}
ORACLES: dict[str, str] = {**items.ORACLES, **sequences.ORACLES, **quizzes.ORACLES, **files.ORACLES, **streams.ORACLES, **prepared.ORACLES, **trees.ORACLES, **docx.ORACLES, **reports.ORACLES, **values.ORACLES}
