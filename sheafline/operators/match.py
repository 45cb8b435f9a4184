"""Matching rows: exact and near duplicates, id resolution, fan-out."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

RATIO = 0.92


@F.pandas_udf(DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratio of matching blocks; not symmetric, so the earlier row goes left."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)], dtype=float)


def letter_counts(x: Column) -> Column:
    """Characters with how often each comes, sorted; the text is cut up once, not for each character."""
    chars = F.sort_array(F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0)))
    counted = lambda of: F.transform(F.array_distinct(of), lambda c: F.struct(c.alias("c"), F.size(F.filter(of, lambda d: d == c)).alias("n")))
    return F.get(F.transform(F.array(chars), counted), F.lit(0))


def ratio_bound(left: Column, right: Column, a: Column, b: Column) -> Column:
    """No less than sequence_ratio: twice the shared characters over all characters."""
    n = lambda counts, c: F.coalesce(F.get(F.filter(counts, lambda x: x.c == c), F.lit(0)).n, F.lit(0))
    shared = F.aggregate(left, F.lit(0), lambda t, x: t + F.least(x.n, n(right, x.c)))
    return 2.0 * shared / F.greatest(F.length(a) + F.length(b), F.lit(1))


def near_duplicate_candidates(df: DataFrame, unit: str, index: str, key: str, ratio: float = RATIO) -> DataFrame:
    """Pairs of a unit that can reach the ratio: lengths in band, then shared characters.

    Rows meet by unit and length bucket, so a pair outside the length band is never formed; the
    filter loses no pair. (unit, left, right, left_key, right_key), left before right.
    """
    low = (2 - ratio) / ratio  # longer over shorter, at most
    rows = df.select(unit, F.col(index).alias("i"), F.col(key).alias("k"), letter_counts(F.col(key)).alias("c"))
    rows = rows.withColumn("n", F.length("k"))
    width = F.log(F.lit(low))
    bucket = F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / width).cast("int")
    left = rows.select(unit, *[F.col(c).alias(f"l_{c}") for c in ("i", "k", "c", "n")], F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("b"))
    right = rows.select(unit, *[F.col(c).alias(f"r_{c}") for c in ("i", "k", "c", "n")], bucket.alias("b"))
    pairs = left.join(right, [unit, "b"]).where("l_i < r_i")
    pairs = pairs.where(2 * F.least("l_n", "r_n") >= ratio * (F.col("l_n") + F.col("r_n")))
    pairs = pairs.where(ratio_bound(F.col("l_c"), F.col("r_c"), F.col("l_k"), F.col("r_k")) >= ratio)
    return pairs.select(unit, F.col("l_i").alias("left"), F.col("r_i").alias("right"), F.col("l_k").alias("left_key"), F.col("r_k").alias("right_key"))


def near_duplicates(df: DataFrame, unit: str, index: str, key: str, ratio: float = RATIO) -> DataFrame:
    """For each row the first earlier row with an equal key or a ratio at least as high."""
    pairs = near_duplicate_candidates(df, unit, index, key, ratio)
    equal = pairs.where("left_key = right_key").withColumn("ratio", F.lit(1.0))
    other = pairs.where("left_key <> right_key").withColumn("ratio", sequence_ratio("left_key", "right_key")).where(F.col("ratio") >= ratio)
    best = equal.unionByName(other).groupBy(unit, "right").agg(F.min(F.struct("left", "ratio")).alias("m"))
    return best.select(unit, F.col("right"), F.col("m.left").alias("left"), F.round("m.ratio", 3).alias("ratio"))


def similar_options(df: DataFrame, keys: list[str], options: str, ratio: float = 0.9) -> DataFrame:
    """Pairs i < j of one row's options that are alike, whatever their case."""
    o = F.posexplode(options)
    left = df.select(*keys, F.col(options).alias("all"), o.alias("i", "left"))
    pairs = left.select(*keys, "i", "left", F.posexplode("all").alias("j", "right")).where("i < j")
    pairs = pairs.withColumn("ratio", sequence_ratio(F.lower("left"), F.lower("right")))
    return pairs.where(F.col("ratio") >= ratio).select(*keys, (F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"), "ratio")


def first_seen(df: DataFrame, key: Column, index: str) -> DataFrame:
    """Adds first_index, the smallest index with the same key; combined before the shuffle."""
    keyed = df.withColumn("__key", key)
    first = keyed.groupBy("__key").agg(F.min(index).alias("first_index"))
    return keyed.join(first, "__key").drop("__key")


def resolve_ids(df: DataFrame, row: str, ids: str, blocks: DataFrame) -> DataFrame:
    """Texts of an id array in array order, and the ids that no block has."""
    asked = df.select(row, F.posexplode(ids).alias("pos", "block_id"))
    found = asked.join(blocks.select("block_id", "text"), "block_id", "left")
    return found.groupBy(row).agg(
        F.array_compact(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x.text)).alias("texts"),
        F.transform(
            F.sort_array(F.collect_list(F.when(F.col("text").isNull(), F.struct("pos", "block_id")))), lambda x: x.block_id
        ).alias("missing"),
    )


def fan_out(regions: DataFrame, region: str, targets: str, value: str) -> DataFrame:
    """(target, value) of the last region that names a target."""
    each = regions.select(F.col(region).alias("r"), F.col(value).alias("v"), F.explode(targets).alias("target"))
    return each.groupBy("target").agg(F.max_by("v", "r").alias(value))


def last_decision(decisions: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The decision written last for each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return decisions.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
