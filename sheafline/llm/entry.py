"""Queries of this subpackage and their oracles.

Oracles are given where SQL can express a query on whole tables. The others are tested against
brute force in tests/llm.
"""

from __future__ import annotations

import corpus_pipeline
from sheafline.llm import (
    collocations,
    decontaminate,
    embedding_join,
    language,
    main_text,
    mixing,
    ngram_join,
    pitman_yor,
    quality,
    repeats,
    secrets,
    url_filter,
    vector_codes,
)


def queries() -> dict:
    return {
        "op1_main_text": main_text.op1,
        "op2_secret_scan": secrets.op2,
        "op3_embedding_join": embedding_join.op3,
        "op4_ngram_join": ngram_join.op4,
        "op5_language_model": pitman_yor.op5,
        "op6_repeated_strings": repeats.op6,
        "op7_mix_sources": mixing.op7,
        "op8_language_id": language.op8,
        "op9_quality_rules": quality.op9,
        "op10_decontaminate": decontaminate.op10,
        "op11_collocations": collocations.op11,
        "op12_vector_codes": vector_codes.op12,
        "op13_url_filter": url_filter.op13,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_mix_sources": mixing.ORACLE,
        "op10_decontaminate": decontaminate.ORACLE,
        "op11_collocations": collocations.ORACLE,
        "op12_vector_codes": vector_codes.ORACLE,
        "op13_url_filter": url_filter.ORACLE,
    }
