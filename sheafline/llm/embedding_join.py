"""Near-duplicate embeddings by collision counting on one-dimensional projections.

All vectors are projected on many random directions and sorted along each. Around every query
vector a window of fixed half-width is laid on each sorted projection; the windows in which a pair
meets are counted, and pairs that meet at least as often as a pair at the threshold does with the
target probability are verified by cosine in double precision.

Counting all pairs that way is quadratic, so it is done inside cells: the signs on a few further
projections deal the vectors into cells of some hundred, and this is repeated on other signs until
a pair at the threshold shares a cell with the target probability. The number of signs grows with
the logarithm of the number of vectors, the number of repeats slowly with it. A cell that is far
too large is compared in blocks, whole. A pair counts in the first cell that it shares.

A cell travels with its vectors alone; the cells of other repeats are worked out where they are
needed. Equal vectors are one class with a representative; links are counted with class sizes.

Defined results: vectors that are null, zero, empty, or hold null or non-finite components link
with nothing and are their own component; vectors of different lengths never link; repeated rows
link with each other; other columns may be present and are ignored; no rows give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm._graph import components, labels
from sheafline.llm._store import written
from sheafline.llm.ngram_join import _gathered, _groups

COSINE = 0.9
#: Projections counted, half-width of a window, vectors a cell holds at most on average.
PROJECTIONS, HALF_WIDTH, CELL = 48, 0.3, 800
#: Target probabilities for a pair at the threshold: to share a cell, and to pass the count.
CELL_RECALL, COUNT_RECALL = 0.99, 0.995
#: A larger cell is compared in pairs of blocks of half as many vectors.
LARGEST = 2048
#: Window partners handled at once when collisions are counted.
PARTNERS = 1 << 19
SEED = 77


def least_count(m: int = PROJECTIONS, half: float = HALF_WIDTH, cosine: float = COSINE, recall: float = COUNT_RECALL) -> int:
    """The largest count that a pair at the threshold reaches with probability `recall`."""
    p = math.erf(half / math.sqrt(2 * (2 - 2 * cosine)) )
    tail, k = 0.0, m + 1
    while tail < recall and k:
        k -= 1
        tail += math.comb(m, k) * p**k * (1 - p) ** (m - k)
    return k


def layout(n: int, cosine: float = COSINE, recall: float = CELL_RECALL, cell: int = CELL) -> tuple[int, int]:
    """(signs of a cell, repeats) for n vectors."""
    signs = max(0, math.ceil(math.log2(max(1, n) / cell)))
    shared = (1 - math.acos(cosine) / math.pi) ** signs
    return signs, 1 if shared >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - shared))


def directions(dim: int, n: int, salt: int) -> np.ndarray:
    return np.random.default_rng([SEED, salt, dim]).standard_normal((dim, n)).astype(np.float32)


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def cells_of(x: np.ndarray, signs: int, repeats: int) -> np.ndarray:
    """The cell of each row of x in each repeat."""
    n, dim = x.shape
    if not signs:
        return np.zeros((n, repeats), dtype=np.int64)
    bits = (x.astype(np.float32) @ directions(dim, signs * repeats, 1) > 0).reshape(n, repeats, signs)
    return (bits * (1 << np.arange(signs, dtype=np.int64))).sum(2)


def _deal(signs: int, repeats: int):
    """(class, size, dim, v) -> a row for each cell, named by repeat, dimension and signs."""

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                cells = cells_of(_rows(part.column("v"), dim), signs, repeats)
                n = len(cells)
                rows = part.take(pa.array(np.repeat(np.arange(n), repeats)))
                repeat = pa.array(np.tile(np.arange(repeats, dtype=np.int32), n))
                yield pa.RecordBatch.from_arrays(
                    [repeat, pa.array(cells.ravel()), rows.column("class"), rows.column("size"), rows.column("dim"), rows.column("v")],
                    ["repeat", "cell", "class", "size", "dim", "v"],
                )

    return run


def collisions(x: np.ndarray, half: float = HALF_WIDTH, m: int = PROJECTIONS) -> np.ndarray:
    """Window collisions of each pair of the rows of x (entry [i, j] or [j, i], the other is 0)."""
    n = len(x)
    count = np.zeros(n * n, dtype=np.uint8)
    for projected in (x.astype(np.float32) @ directions(x.shape[1], m, 2)).T:
        order = np.argsort(projected, kind="stable")
        s = projected[order]
        to = np.searchsorted(s, s + np.float32(half), "right")
        length = to - np.arange(1, n + 1)  # partners after each query in its window
        upto, lo = np.cumsum(length), 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PARTNERS, "right")))
            some = length[lo:hi]
            first = np.repeat(np.arange(lo + 1, hi + 1) - np.cumsum(some) + some, some)
            a, b = np.repeat(order[lo:hi], some), order[first + np.arange(len(first))]
            count[np.minimum(a, b) * n + np.maximum(a, b)] += 1
            lo = hi
    return count.reshape(n, n)


def _count_and_verify(cosine: float, signs: int, repeats: int):
    least = least_count(cosine=cosine)

    def run(batches):
        for table in _gathered(batches, "group"):
            keys = table.column("group").to_numpy()
            ids, size, repeat, own, dims = (table.column(c).to_numpy() for c in ("class", "size", "repeat", "own", "dim"))
            vectors = table.column("v").combine_chunks()
            for lo, hi in _groups(keys):
                if hi - lo < 2:
                    continue
                single = _rows(vectors.slice(lo, hi - lo), int(dims[lo]))
                x = single.astype(np.float64)
                norm = np.sqrt((x * x).sum(1))
                i, j = np.nonzero(collisions(x / norm[:, None]) >= least)
                if len(i):
                    mine = np.ones(len(i), dtype=bool)
                    if repeat[lo]:  # a pair counts in the first repeat in which it shares a cell
                        before = cells_of(single, signs, repeats)[:, : repeat[lo]]
                        mine = ~(before[i] == before[j]).any(1)
                    if len(np.unique(own[lo:hi])) > 1:  # a pair of one block counts in the block's own group
                        mine &= own[lo:hi][i] != own[lo:hi][j]
                    i, j = i[mine], j[mine]
                    near = np.einsum("ij,ij->i", x[i], x[j]) / (norm[i] * norm[j]) >= cosine
                    i, j = i[near], j[near]
                if len(i):
                    label = labels(hi - lo, i, j)
                    w = size[lo:hi]
                    linked = np.bincount(i, w[j], hi - lo) + np.bincount(j, w[i], hi - lo)
                    some = np.flatnonzero(linked)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[lo:hi][some]), pa.array(linked[some].astype(np.int64)), pa.array(ids[lo:hi][label[some]])],
                        ["class", "linked", "root"],
                    )

    return run


def near_duplicates(rows: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id) for every row."""
    v = F.col(embedding).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))
    every = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(valid, F.col(embedding)).alias("v"))
    # equal vectors meet by 128 bits, 0.0 and -0.0 alike
    plain = F.transform("v", lambda x: x + F.lit(0.0).cast("float"))
    every = every.withColumn("one", F.when(F.col("v").isNotNull(), F.xxhash64(plain))).withColumn("two", F.xxhash64(F.lit(1), plain))
    classes = written(
        every.where("one IS NOT NULL").groupBy("one", "two").agg(
            F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("size"), F.first("v").alias("v")
        ).withColumns({"dim": F.size("v"), "class": F.monotonically_increasing_id()})
    )
    signs, repeats = layout(classes.count(), cosine)
    dealt = classes.select("class", "size", "dim", "v").mapInArrow(
        _deal(signs, repeats), "repeat int, cell long, class long, size long, dim int, v array<float>"
    )
    keys = ["repeat", "dim", "cell"]
    large = written(dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGEST))
    if large.head(1):
        dealt = dealt.join(large, keys, "left")
    else:
        dealt = dealt.withColumn("n", F.lit(None).cast("long"))
    blocks = F.when(F.col("n").isNull(), F.lit(1)).otherwise(F.ceil(F.col("n") * 2 / LARGEST).cast("int"))
    dealt = dealt.withColumn("blocks", blocks)
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("class", F.lit(3)), F.col("blocks").cast("long")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("group", F.xxhash64(*keys, F.least("own", "other"), F.greatest("own", "other")))
    links = written(
        dealt.select("group", "repeat", "class", "size", "dim", "own", "v")
        .repartition("group")
        .sortWithinPartitions("group")
        .mapInArrow(_count_and_verify(cosine, signs, repeats), "class long, linked long, root long")
    )
    root = components(links.select(F.col("class").alias("a"), F.col("root").alias("b")))
    linked = links.groupBy("class").agg(F.sum("linked").alias("linked"))
    known = classes.drop("v", "dim").join(root.withColumnRenamed("node", "class"), "class", "left").join(linked, "class", "left")
    known = known.withColumn("root", F.coalesce("root", "class"))
    named = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = known.join(named, "root").select(
        "one", "two", "component_id", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")
    )
    return every.drop("v").join(known, ["one", "two"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )


def op3(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
