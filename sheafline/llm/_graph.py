"""Connected components: vectorised inside a task, by alternating stars across tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm._store import dropped, written


def labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows reaches over the pairs (left, right)."""
    label = np.arange(n)
    while len(left):
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


#: Nodes with at least this part of all edges are broadcast: at most HOT of either end.
HOT = 1000


def _with_least(edges: DataFrame, key: str, value: str, total: int) -> tuple[DataFrame, DataFrame]:
    """(`edges`, a written table, with m, the smallest `value` of its `key`; the table of these, to be dropped).

    Keys with very many edges are not shuffled; without any nothing is broadcast. Both tables are written, since a
    plan that holds one within the other as often as it is read takes the driver's memory.
    """
    least = written(edges.groupBy(key).agg(F.min(value).alias("m"), F.count(F.lit(1)).alias("n")))
    limit = max(256, -(-total // HOT))
    if not least.where(F.col("n") >= limit).head(1):
        return edges.join(least.select(key, "m"), key), least
    hot = least.where(F.col("n") >= limit).select(key, F.col("m").alias("__hot"))
    told = edges.join(F.broadcast(hot), key, "left")
    rest = least.where(F.col("n") < limit).select(key, "m")
    found = told.where("__hot IS NULL").drop("__hot").join(rest, key)
    return found.unionByName(told.where("__hot IS NOT NULL").withColumnRenamed("__hot", "m")), least


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b long): root is the smallest node it reaches.

    Large-star and small-star steps in turn until nothing changes, O(log n) rounds of two
    aggregations each. Sums per node are combined before the shuffle; what they tell of nodes with a
    thousandth of all edges is broadcast, of the others joined. Each round cuts its lineage.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    print_of = (F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"))
    before = e.agg(*print_of).first()
    while before.n:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        told, of_u = _with_least(both, "u", "v", before.n)
        large = written(told.where("v > u").select(F.col("v").alias("a"), F.least("m", "u").alias("b")).distinct())
        told, of_a = _with_least(large, "a", "b", before.n)
        low = written(told)
        small = low.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, e = e, written(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        dropped(last, of_u, large, of_a, low)
        now = e.agg(*print_of).first()
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
