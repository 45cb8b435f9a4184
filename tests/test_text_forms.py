"""NFC and case folding: what stays out of Python, and that results are Python's."""

import re
import unicodedata

from pyspark.sql import functions as F

from sheafline.functions import text as T


def characters(ranges):
    return [chr(c) for a, b in re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", ranges) for c in range(int(a, 16), int(b, 16) + 1)]


def test_safe_characters_never_change():
    seconds = {chr(c) for r in (range(0x1161, 0x1176), range(0x11A8, 0x11C3)) for c in r}
    for c in range(0x110000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            seconds.add(chr(int(parts[1], 16)))
    for c in characters(T.NFC_SAFE):
        assert unicodedata.normalize("NFC", c) == c and unicodedata.combining(c) == 0 and c not in seconds, hex(ord(c))
    for c in characters(T.FOLD_SAFE):
        assert c.lower() == c.casefold(), hex(ord(c))


def test_forms_are_those_of_python(spark):
    folds = characters(T.FOLD_SAFE)
    texts = ["", None, "e\u0301", "plain", "\u212b \u2126", "각", "ᄀ\u1161\u11a8", "кра\u0306и", "Straße ΑΣ µ İ", "a\u0315\u0300", "日本\u3099", "😀 ok", "x" * 50_000, *folds]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", T.nfc(F.col("t")).alias("n"), T.casefold(F.col("t")).alias("c")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.i]
        assert (r.n, r.c) == ((None, None) if t is None else (unicodedata.normalize("NFC", t), t.casefold())), t


def test_plain_texts_stay_out_of_python(spark):
    """What goes to Python are nulls, so that its batches do not grow with the texts."""
    sent = spark.sparkContext.accumulator(0)

    def count(x):
        sent.add(sum(len(s) for s in x.dropna()))
        return x

    tap = F.pandas_udf(count, "string")
    kept, T._composed = T._composed, tap
    try:
        texts = spark.createDataFrame([("слово word " * 500,)] * 50 + [("e\u0301",)], "t string")
        assert texts.select(T.nfc(F.col("t")).alias("n")).where("n IS NULL").count() == 0
    finally:
        T._composed = kept
    assert sent.value == 2
