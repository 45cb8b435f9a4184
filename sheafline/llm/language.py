"""Language identification by nearest centroids.

A text is a vector of hashed byte trigrams (A-Z lower-cased, other ASCII a space), square roots of
counts times inverse document frequencies, normalised. The frequencies cover all training rows.
Every language has a few centroids, found by spherical k-means on a bounded sample of its training
rows. The nearest centroid by cosine names the language; a text farther from it than nearly all of
its own members are is marked as rejected.

Defined results: `und` and score 0 for a null text or one without a letter, and for every text if
nothing can be learned; equally near centroids resolve to the language that sorts first; texts are
read whole; rows are independent, so repeated rows and extra columns need no care.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.llm import _arrays as A

FEATURES = 4096
CENTROIDS = 3
#: Training rows per language on which centroids are fitted (about as many: taken by a digest).
SAMPLE = 1200
#: Share of a centroid's own members that lie farther away than what it accepts.
FAR_SHARE = 0.005
ROUNDS = 8
#: Rows of one matrix in a task: 16 MB.
ROWS_AT_ONCE = 1024

_CLASS = A.LOWERED.copy()
_CLASS[[b for b in range(128) if not (97 <= b <= 122 or 65 <= b <= 90)]] = 32


def counts(column: pa.Array):
    """For chunks of rows: (lo, hi, matrix of trigram counts)."""
    raw, offsets = A.flat(column)
    for lo, hi in A.chunks(offsets, A.CHUNK // 2, ROWS_AT_ONCE):
        out = np.zeros((hi - lo, FEATURES), dtype=np.float32)
        part = _CLASS[raw[offsets[lo] : offsets[hi]]].astype(np.uint32)
        if len(part) >= 3:
            key = (part[:-2] * np.uint32(0x9E3779B1) ^ part[1:-1] * np.uint32(0x85EBCA77) ^ part[2:] * np.uint32(0xC2B2AE3D))
            key = (key * np.uint32(0x27D4EB2F)) >> np.uint32(20)
            row = np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1]))
            same = (row[2:] == row[:-2]) & ~((part[:-2] == 32) & (part[1:-1] == 32))
            flat = row[:-2][same] * FEATURES + key[same]
            out = np.bincount(flat, minlength=(hi - lo) * FEATURES).astype(np.float32).reshape(hi - lo, FEATURES)
        yield lo, hi, out


def vectors(column: pa.Array, idf: np.ndarray):
    for lo, hi, x in counts(column):
        np.sqrt(x, out=x)
        x *= idf
        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
        yield lo, hi, x


def _frequencies(batches):
    total, n = np.zeros(FEATURES, dtype=np.int64), 0
    for batch in batches:
        for lo, hi, x in counts(batch.column("text")):
            total += np.count_nonzero(x, axis=0)
            n += hi - lo
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.int64()))], ["n", "df"])


def _clusters(idf: np.ndarray):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"])
        x = np.concatenate([v for _, _, v in vectors(pa.array(pdf["text"], pa.string()), idf)])
        centre = x[np.linspace(0, len(x) - 1, min(CENTROIDS, len(x))).astype(int)].copy()
        for _ in range(ROUNDS):
            own = (x @ centre.T).argmax(1)
            for k in range(len(centre)):
                if (own == k).any():
                    mean = x[own == k].sum(0)
                    centre[k] = mean / max(float(np.linalg.norm(mean)), 1e-12)
        near = x @ centre.T
        own = near.argmax(1)
        floor = [float(np.quantile(near[own == k, k], FAR_SHARE)) if (own == k).any() else 0.0 for k in range(len(centre))]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "floor": floor, "centroid": [c.tolist() for c in centre]})

    return fit


class Model:
    """Centroids of all languages: CENTROIDS * FEATURES floats for each."""

    def __init__(self, idf: np.ndarray, langs: list[str], floors: np.ndarray, centroids: np.ndarray):
        self.idf, self.langs, self.floors, self.centroids = idf, langs, floors, centroids


def fit(train: DataFrame, *, sample: int = SAMPLE) -> Model | None:
    """Learns from (doc_id, text, lang); rows without a text or a language are left out."""
    train = train.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    seen = np.zeros(FEATURES)
    n = 0
    for r in train.select("text").mapInArrow(_frequencies, "n long, df array<long>").select(
        "n", F.posexplode("df").alias("feature", "df")
    ).groupBy("feature").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).collect():
        seen[r["feature"]], n = r["df"], r["n"]
    idf = (np.log((n + 1) / (seen + 1)) + 0.1).astype(np.float32)
    share = F.lit(0.0)
    for lang, size in sizes.items():
        share = F.when(F.col("lang") == lang, float(min(1.0, sample / size))).otherwise(share)
    digest = F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    picked = train.where(digest < share).dropDuplicates(["lang", "doc_id", "text"])  # copies of a row count once
    fitted = picked.groupBy("lang").applyInPandas(_clusters(idf), "lang string, floor double, centroid array<float>")
    rows = sorted(fitted.collect(), key=lambda r: r["lang"])
    if not rows:
        return None
    return Model(idf, [r["lang"] for r in rows], np.array([r["floor"] for r in rows]), np.array([r["centroid"] for r in rows], dtype=np.float32))


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """`docs` with lang_pred, score and rejected."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "rejected": F.lit(True)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double, rejected boolean")
    def nearest(column: pa.Array) -> pa.Array:
        m = shared.value
        best, score = np.zeros(len(column), dtype=np.int64), np.zeros(len(column))
        for lo, hi, x in vectors(column, m.idf):
            near = x @ m.centroids.T
            best[lo:hi] = near.argmax(1)
            score[lo:hi] = near.max(1)
        names = pa.array(m.langs, pa.string()).take(pa.array(best))
        return pa.StructArray.from_arrays(
            [names, pa.array(np.clip(score, 0.0, 1.0)), pa.array(score < m.floors[best])], ["lang", "score", "rejected"]
        )

    found = docs.withColumn("__near", nearest(F.col(text)))
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return found.withColumns(
        {
            "lang_pred": F.when(letters, F.col("__near.lang")).otherwise(F.lit("und")),
            "score": F.when(letters, F.col("__near.score")).otherwise(F.lit(0.0)),
            "rejected": ~letters | F.col("__near.rejected"),
        }
    ).drop("__near")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n).cast("long"))


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = fit(docs.where(~held_out))
    return identify(docs.drop("lang").withColumn("held_out", held_out), model).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected"
    )
