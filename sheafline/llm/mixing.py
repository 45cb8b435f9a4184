"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Every document gets the exponential key -ln(u) / quality, u from a digest of the seed, its id and its
text.
A source's target is first spent on complete epochs; what remains is filled in key order until the
running number of words reaches it, and the document that crosses the budget is taken in part. The
running sum never sorts a source as a whole: keys are dealt into slices of equal width in ln(key), slices
are summed, and only the slice in which a source's budget ends is sorted. A weight scales keys and so only shifts
their logarithms: whatever the weights, a slice holds about 1 / (e * SLICES) of the different rows of a source at most.

Defined results: a null text has size 0 and takes nothing; a null source is a source of its own,
last; a source without words has target 0; null and repeated ids are told apart by the text, equal
rows share a key and may swap places; without documents the result is empty; other columns pass through, those
named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.llm._store import written

TOKEN = r"[^\x20\x09-\x0D]+"
#: Slices for each factor of e in a source's keys; one slice of one source is sorted in one task.
SLICES = 1024
#: Keys below are one slice.
LEAST_KEY = 1e-9
#: More sources than this are joined by shuffle instead of broadcast.
BROADCAST_SOURCES = 100_000


def uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in (0, 1) made of 52 digest bits of id and text."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def quality_weight(text: Column, size: Column) -> Column:
    """1 for six characters a word (white space counted), less the farther from it, 0.1 at least."""
    mean = F.char_length(text) / F.greatest(size, F.lit(1))
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.abs(F.coalesce(mean, F.lit(6.0)) - 6.0) / 12.0)


def slice_of(key: Column, slices: int = SLICES) -> Column:
    return F.floor(F.log(F.greatest(key, F.lit(LEAST_KEY))) * slices).cast("int")


def targets(sources: DataFrame, max_epochs: int) -> DataFrame:
    """(source, source_size) -> plus target: shares by weight, capped, the excess dealt again.

    With r = cap / weight ascending, the capped sources are a prefix: the smallest one after which
    the remaining words per remaining weight no longer exceed the next r.
    """
    by_code = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    s = sources.withColumn("weight", (((F.row_number().over(by_code) - 1) % 3) + 1).cast("double"))
    s = s.withColumn("cap", F.col("source_size") * float(max_epochs))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    w = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    s = s.withColumns(
        {
            "spent": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "weighed": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
            "total": F.sum("source_size").over(every).cast("double"),
            "weights": F.sum("weight").over(every),
        }
    )
    s = s.withColumn("level", (F.col("total") - F.col("spent")) / (F.col("weights") - F.col("weighed")))
    s = s.withColumn("final", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"])
    return s.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.col("final")).alias("target"))


def mix(
    docs: DataFrame,
    *,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weight: Column | None = None,
    seed: str = "mix-1",
    max_epochs: int = 3,
    slices: int = SLICES,
) -> DataFrame:
    """`docs` with size, source_size, target and taken (words that the mix takes of the document)."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(TOKEN)), F.lit(0)).cast("long")
    rows = docs.drop("source_size", "target", "taken").withColumn("size", size)
    quality = quality_weight(F.col(text), F.col("size")) if weight is None else weight
    # key = -ln(u) / quality, kept with the slice that it falls in
    rows = rows.withColumn("__key", F.round(-F.log(uniform(F.col(doc_id), F.col(text), seed)) / quality, 9))
    rows = rows.withColumn("__slice", slice_of(F.col("__key"), slices))

    sums = written(rows.groupBy(F.col(source).alias("source"), F.col("__slice").alias("slice")).agg(F.sum("size").alias("words")))
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), max_epochs)
    goal = goal.withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    ).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)  # about 30 * slices rows each
    cut = (
        sums.withColumn("upto", F.sum("words").over(upto))
        .withColumnRenamed("source", "of")
        .join(goal, F.col("of").eqNullSafe(F.col("source")))
        .where(F.col("upto") >= F.col("rest"))
        .groupBy("source", "source_size", "target", "epochs", "rest")
        .agg(F.min(F.struct("slice", (F.col("upto") - F.col("words")).alias("before"))).alias("last"))
    )
    cut = written(
        cut.select(
            F.col("source").alias("__of"), "source_size", "target", F.col("epochs").alias("__epochs"), F.col("rest").alias("__rest"),
            F.col("last.slice").alias("__last"), F.col("last.before").alias("__before"),
        )
    )
    known = F.broadcast(cut) if cut.count() <= BROADCAST_SOURCES else cut
    rows = rows.join(known, F.col(source).eqNullSafe(F.col("__of"))).drop("__of")
    whole = rows.where(F.col("__slice") != F.col("__last")).withColumn(
        "__part", F.when(F.col("__slice") < F.col("__last"), F.col("size")).otherwise(F.lit(0).cast("long"))
    )
    order = Window.partitionBy(source).orderBy("__key", doc_id, "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = rows.where(F.col("__slice") == F.col("__last"))
    edge = edge.withColumn("__before", F.col("__before") + F.sum("size").over(order) - F.col("size")).withColumn(
        "__part", F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col("__rest") - F.col("__before")))
    )
    return (
        whole.unionByName(edge)
        .withColumn("taken", F.col("__epochs") * F.col("size") + F.col("__part"))
        .drop("__key", "__slice", "__epochs", "__rest", "__last", "__before", "__part")
    )


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    (CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS DOUBLE) + 0.5)
      / 4503599627370496.0 AS u, length(text) AS chars FROM documents),
k AS (
  SELECT doc_id, source, size,
    round(-ln(u) / greatest(0.1, 1.0 - abs(coalesce(chars / greatest(size, 1), 6.0) - 6.0) / 12.0), 9) AS key FROM d),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM k GROUP BY source),
r AS (SELECT *, source_size * 3.0 AS cap, source_size * 3.0 / weight AS ratio FROM s),
p AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER before, 0.0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0)) AS level
  FROM r WINDOW before AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, ratio) AS final FROM p WHERE level <= ratio),
t AS (SELECT source, source_size, least(cap, weight * final) AS target FROM p, f),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
q AS (SELECT *, CAST(round(target - epochs * source_size) AS BIGINT) AS rest FROM e),
o AS (
  SELECT k.doc_id, k.size, q.source_size, q.target, q.epochs, q.rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) - k.size AS before
  FROM k JOIN q ON k.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + least(size, greatest(0, rest - before)) AS BIGINT) AS taken FROM o
"""
