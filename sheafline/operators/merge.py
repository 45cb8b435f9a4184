"""Merging results of several passes, resuming, and seeded permutations."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RETRYABLE = ("gpt_request_failed",)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows by key, those of `new` win."""
    columns = old.columns
    both = old.withColumn("__gen", F.lit(0)).unionByName(new.select(*columns).withColumn("__gen", F.lit(1)))
    newest = both.groupBy(key).agg(F.max_by(F.struct(*columns), "__gen").alias("row"))
    return newest.select("row.*")


def done_ids(clean: DataFrame, review: DataFrame, key: str, reason: str) -> DataFrame:
    """Ids that need no further attempt: clean ones, and reviewed ones unless the reason can be retried."""
    final = review.where(~F.col(reason).isin(*RETRYABLE))
    return clean.select(key).union(final.select(key)).distinct()


def todo(rows: DataFrame, done: DataFrame, key: str, start: int | None = None) -> DataFrame:
    """Rows from `start` on that are not done; the anti join comes before any costly call."""
    rows = rows if start is None else rows.where(F.col(key) >= start)
    return rows.join(done, key, "left_anti")


def hash_order(options: Column, *key: Column) -> Column:
    """Options in the order of digests of key and position: (position from 0, text)."""
    keyed = F.transform(
        options, lambda x, i: F.struct(F.sha2(F.concat_ws(":", *key, i.cast("string")), 256).alias("h"), i.alias("i"), x.alias("x"))
    )
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s.i.alias("i"), s.x.alias("x")))


SHUFFLED = T.StructType([T.StructField("options", T.ArrayType(T.StringType())), T.StructField("answers", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(SHUFFLED)
def seeded_shuffle(key: pd.Series, options: pd.Series, answers: pd.Series) -> pd.DataFrame:
    """Options permuted by a generator seeded with the key; correctness moves with its option."""
    out = []
    for k, o, a in zip(key, options, answers, strict=True):
        right = {int(i) for i in a}
        flagged = [(x, i + 1 in right) for i, x in enumerate(o)]
        random.Random(k).shuffle(flagged)
        out.append(([x for x, _ in flagged], [i + 1 for i, (_, ok) in enumerate(flagged) if ok]))
    return pd.DataFrame(out, columns=["options", "answers"])


def normalise_with_retries(df: DataFrame, attempt, attempts: int = 3, schema: str = "id long, outcome string, reason string, tries int") -> DataFrame:
    """Calls attempt(row, last_error) -> (ok, error) up to `attempts` times for each row.

    Rows come back as clean, or as review with the reason: the last error where it is one that a
    later run can retry or a broken answer, otherwise that the attempts ran out.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                error, tries, ok = None, 0, False
                while tries < max(1, attempts) and not ok:
                    tries += 1
                    ok, error = attempt(row, error)
                    if error == "needs_visual_review":
                        break
                kept = error in ("bad_json", "needs_visual_review", *RETRYABLE)
                out.append((row["id"], "clean" if ok else "review", None if ok else error if kept else "max_retries_exceeded", tries))
            yield pd.DataFrame(out, columns=["id", "outcome", "reason", "tries"])

    return df.mapInPandas(run, schema)


def processed_before_outage(df: DataFrame, order: str, unit: str, reason: str = "reason") -> DataFrame:
    """Rows of a unit up to its first outage, that one included; what follows was never tried."""
    first = df.where(F.col(reason).isin(*RETRYABLE)).groupBy(unit).agg(F.min(order).alias("__stop"))
    return df.join(first, unit, "left").where(F.col("__stop").isNull() | (F.col(order) <= F.col("__stop"))).drop("__stop")
