import random
import re

import pytest

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(AZ))


def prose(seed, n):
    draw = random.Random(seed)
    parts = "the of and ou er an in th on es re ti at ed nd ha sh ou ing ble".split()
    return " ".join("".join(draw.choices(parts, k=draw.randint(1, 4))) for _ in range(n))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, near copies."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "en", "b"), (4, prose(2, 80), None, None), (5, None, "fr", "b"),
        (6, "", "fr", None), (7, " \n\t ", "de", "a"), (8, prose(3, 30_000), "de", "a"), (9, "one two", "en", "c"), (9, "one two", "en", "c"),
        (None, prose(4, 50), "en", "b"), (None, None, None, None), (10, "é É ß 日本語 𝒳 🙂", "fr", "b"), (11, base.upper(), "en", "c"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
