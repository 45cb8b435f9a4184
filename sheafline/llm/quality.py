"""Quality classifier: a sparse rule ensemble.

Every text gets a dozen statistics. Small trees, grown on random halves of the labelled rows, turn
into conjunctive rules (the path to each node); a logistic model with a lasso penalty keeps the few
rules that matter; rules and weights are compiled into one Spark column expression over the
statistics.

The model is fitted on at most `MAX_LABELLED` labelled rows, taken by a digest of the id; the
statistics of texts and the scores cover all rows.

Defined results: a null text scores as an empty one; an id with several labels counts once for
each; without labelled rows of both kinds every score is the share of label 1 (0.5 if there are no
rows); rows are independent, so repeated rows and extra columns need no care.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafline.llm import _arrays as A
from sheafline.llm.language import remainder

MAX_LABELLED = 8000
TREES, DEPTH, LEAST = 40, 3, 20
PENALTY = 0.002
THRESHOLD = 0.3

STATISTICS = (
    "length", "words", "word_length", "upper", "digits", "symbols", "pipes", "marks", "distinct", "top_word", "repeats",
    "repeated_lines", "line_words",
)
SCHEMA = T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS])

_UPPER = np.zeros(256, dtype=np.float32)
_UPPER[65:91] = 1
_LETTER = np.zeros(256, dtype=np.float32)
_LETTER[65:91] = _LETTER[97:123] = 1
_DIGIT = np.zeros(256, dtype=np.float32)
_DIGIT[48:58] = 1
_SYMBOL = np.zeros(256, dtype=np.float32)
_SYMBOL[[*b"#$%&*+/<=>@[\\]^_`{}~"]] = 1
_MARK = np.zeros(256, dtype=np.float32)
_MARK[[*b"!?;:"]] = 1
_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[[10, 13]] = True


def _per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _distinct(row: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: how many different hashes, and how often the commonest comes."""
    distinct, top = np.zeros(n), np.zeros(n)
    if len(row):
        key = np.sort((row.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        run = np.diff(np.concatenate([starts, [len(key)]]))
        of = (key[starts] >> np.uint64(40)).astype(np.int64)
        distinct = np.bincount(of, minlength=n).astype(float)
        np.maximum.at(top, of, run)
    return distinct, top


def statistics_of(column: pa.Array) -> dict[str, np.ndarray]:
    raw, offsets = A.flat(column)
    out = {s: np.zeros(len(column)) for s in STATISTICS}
    for lo, hi in A.chunks(offsets):
        part, ends = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        n, size = hi - lo, np.maximum(np.diff(ends), 1)
        row, start, end = A.tokens(part, ends, A.SPACES)
        sums = A.prefix_hash(A.LOWERED[part])
        words = A.range_hash(sums, start, end)
        n_words = np.bincount(row, minlength=n).astype(float)
        some = np.maximum(n_words, 1)
        distinct, top = _distinct(row, words, n)
        again = np.bincount(row[1:][(row[1:] == row[:-1]) & (words[1:] == words[:-1])], minlength=n)
        l_row, l_start, l_end = A.tokens(part, ends, _NEWLINE)
        lines = np.bincount(l_row, minlength=n).astype(float)
        l_distinct, _ = _distinct(l_row, A.range_hash(sums, l_start, l_end), n)
        letters = np.maximum(_per_row(_LETTER[part], ends), 1)
        for name, value in (
            ("length", np.log1p(np.diff(ends))),
            ("words", np.log1p(n_words)),
            ("word_length", np.bincount(row, end - start, minlength=n) / some),
            ("upper", _per_row(_UPPER[part], ends) / letters),
            ("digits", _per_row(_DIGIT[part], ends) / size),
            ("symbols", _per_row(_SYMBOL[part], ends) / size),
            ("pipes", _per_row(part == 124, ends) / size),
            ("marks", _per_row(_MARK[part], ends) / size),
            ("distinct", distinct / some),
            ("top_word", top / some),
            ("repeats", again / some),
            ("repeated_lines", 1 - l_distinct / np.maximum(lines, 1)),
            ("line_words", np.log1p(n_words / np.maximum(lines, 1))),
        ):
            out[name][lo:hi] = value
    return out


@F.arrow_udf(SCHEMA)
def statistics(column: pa.Array) -> pa.Array:
    found = statistics_of(column)
    return pa.StructArray.from_arrays([pa.array(np.round(found[s], 6)) for s in STATISTICS], list(STATISTICS))


#: A rule: conditions (number of the statistic, whether above, limit), all of which hold.
Rule = tuple[tuple[int, bool, float], ...]


def grow(x: np.ndarray, y: np.ndarray, draw: np.random.Generator, depth: int, path: Rule = ()) -> list[Rule]:
    """Paths to all nodes of a tree that splits on a few random statistics at a time."""
    if not depth or len(y) < 2 * LEAST or y.min() == y.max():
        return [path] if path else []
    best = (1e-9, None)
    for k in draw.choice(x.shape[1], size=5, replace=False):
        limits = np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, 25)))
        above = x[:, k][:, None] > limits
        n1 = above.sum(0)
        n0 = len(y) - n1
        s1 = y @ above
        s0 = y.sum() - s1
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = s1**2 / n1 + s0**2 / n0 - y.sum() ** 2 / len(y)
        gain[(n1 < LEAST) | (n0 < LEAST)] = 0
        if gain.max() > best[0]:
            best = (gain.max(), (int(k), float(limits[gain.argmax()])))
    if best[1] is None:
        return [path] if path else []
    k, limit = best[1]
    found = [path] if path else []
    for above in (False, True):
        part = (x[:, k] > limit) == above
        found += grow(x[part], y[part], draw, depth - 1, (*path, (k, above, limit)))
    return found


def fires(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, k] > limit) == above for k, above, limit in rule])


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradients; the columns of `r` (booleans) are scaled by their deviation."""
    mean = r.mean(0)
    scale = np.maximum(np.sqrt(mean * (1 - mean)), 0.02)
    z = r.astype(float)  # the one table of floats: this runs in the driver
    z -= mean
    z /= scale
    step = 4.0 * len(y) / max(float(np.linalg.eigvalsh(z.T @ z)[-1]), 1e-9)  # the squared spectral norm
    b, w = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), np.zeros(r.shape[1])
    v, t = w.copy(), 1.0
    for _ in range(rounds):
        miss = 1 / (1 + np.exp(-(z @ v + b))) - y
        new = v - step * (z.T @ miss) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
        b -= 2.0 * miss.mean()
    w = w / scale
    return b - float(mean @ w), w


class RuleEnsemble:
    def __init__(self, intercept: float, rules: list[Rule], weights: list[float]):
        self.intercept, self.rules, self.weights = intercept, rules, weights

    def score(self, stats: str) -> Column:
        """The ensemble as one expression over the struct column `stats`."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            tests = [F.col(f"{stats}.{STATISTICS[k]}") > limit if above else F.col(f"{stats}.{STATISTICS[k]}") <= limit for k, above, limit in rule]
            total = total + F.when(reduce(Column.__and__, tests), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(labelled: DataFrame, *, text: str = "text", label: str = "quality", seed: int = 11) -> RuleEnsemble:
    """Fits on the rows given, a bounded number; with a column s of statistics, the texts are not asked for."""
    found = F.col("s") if "s" in labelled.columns else statistics(F.col(text))
    rows = labelled.where(F.col(label).isin(0, 1)).select(F.col("doc_id"), found.alias("s"), F.col(label).alias("y"))
    table = rows.select("doc_id", "s.*", "y").orderBy("doc_id", *STATISTICS, "y").toPandas()
    x, y = table[list(STATISTICS)].to_numpy(float), table["y"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return RuleEnsemble(float(np.log(share / (1 - share))), [], [])
    draw = np.random.default_rng(seed)
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        half = draw.permutation(len(y))[: max(len(y) // 2, min(len(y), 2 * LEAST))]
        rules |= dict.fromkeys(grow(x[half], y[half], draw, DEPTH))
    named = list(rules)
    holds: dict[bytes, Rule] = {}
    for rule in named:
        holds.setdefault(np.packbits(fires(rule, x)).tobytes(), rule)  # of rules that hold for the same rows, the first
    if not holds:
        return RuleEnsemble(float(np.log(y.mean() / (1 - y.mean()))), [], [])
    named = list(holds.values())
    b, w = lasso_logistic(np.stack([fires(rule, x) for rule in named], axis=1), y, PENALTY)
    used = np.flatnonzero(np.abs(w) > 1e-4)
    return RuleEnsemble(b, [named[i] for i in used], [float(w[i]) for i in used])


def fraction(*columns: str) -> Column:
    """A digest of some columns as a number from 0 to 1."""
    return F.pmod(F.xxhash64(*columns, F.lit(9)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def training_rows(docs: DataFrame, labels: DataFrame, *, most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, s: statistics of the text, quality) of labelled training rows, at most `most` of them, taken by a digest."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 5) != 0))
    known = known.select("doc_id", "quality")
    share = min(1.0, 2 * most / max(1, known.count()))  # twice as many, of which the first by digest stay
    picked = known.where(fraction("doc_id", "quality") < share)
    picked = picked.orderBy(F.xxhash64("doc_id", "quality"), "doc_id", "quality").limit(most)
    both = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # bounded by `most`
    told = both.select("doc_id", statistics(F.col("text")).alias("s"), "quality", F.xxhash64("doc_id", "text", "quality").alias("__h"))
    return told.orderBy("__h", "doc_id", "quality").limit(most).drop("__h")  # where ids repeat; no text leaves its task


def scored(docs: DataFrame, model: RuleEnsemble, text: str = "text") -> DataFrame:
    """`docs` with score and predicted."""
    found = docs.withColumn("__s", statistics(F.col(text))).withColumn("score", model.score("__s")).drop("__s")
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored(docs.withColumn("held_out", remainder(F.col("doc_id"), 5) == 0), model).select(
        "doc_id", "held_out", "score", "predicted"
    )
