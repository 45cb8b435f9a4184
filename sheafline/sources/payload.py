"""Blocks of a document from JSON of several shapes, and block ids in several spellings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that mean the same field, in the order they are asked for; fields that hold the blocks.
ID, KIND, TEXT, MEDIA = ("id", "block_id"), ("kind", "type"), ("text", "text_md", "content"), ("media_refs", "media")
HOLDERS = ("blocks", "source_blocks")


def _said(v: Column, names: Sequence[str]) -> Column:
    """The first of these fields that says something (not missing, null, false, 0 or empty), as text."""
    text = lambda n: F.try_variant_get(v, f"$.{n}", "string")
    return F.coalesce(*[F.when(~text(n).isin("", "false", "0", "0.0", "[]", "{}"), text(n)) for n in names])


def padded(digits: Column) -> Column:
    """Four digits at least; longer numbers stay whole (lpad alone would cut them)."""
    return F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)


def blocks(files: DataFrame, file: str, doc: str) -> DataFrame:
    """(file, pos, block_id, kind, text, media, is_image) of payloads: `blocks` or `source_blocks`, a list of objects or an object of texts.

    Each field may have one of several names. A block of a list without an id is named b0001 and so on by its place; entries that are no
    objects are left out but keep their place. A payload without blocks gives no rows. Ids that come twice stay twice.
    """
    spark = files.sparkSession
    at = lambda n: F.try_variant_get(F.col(doc), f"$.{n}", "variant")
    full = lambda v: F.coalesce(F.size(F.try_variant_get(v, "$", "array<variant>")) > 0, F.size(F.try_variant_get(v, "$", "map<string,variant>")) > 0, F.lit(False))
    held = F.coalesce(*[F.when(full(at(n)), at(n)) for n in HOLDERS])
    each = files.select(F.col(file).alias("file"), held.alias("held")).where("held IS NOT NULL")
    each = each.lateralJoin(spark.tvf.variant_explode(F.col("held").outer()).select("pos", "key", F.col("value").alias("b")))
    b, listed = F.col("b"), F.col("key").isNull()
    is_object = F.try_variant_get(b, "$", "map<string,variant>").isNotNull()
    named = F.coalesce(_said(b, ID), F.concat(F.lit("b"), padded((F.col("pos") + 1).cast("string"))))
    media = F.coalesce(*[F.when(F.size(F.try_variant_get(b, f"$.{n}", "array<string>")) > 0, F.try_variant_get(b, f"$.{n}", "array<string>")) for n in MEDIA], F.array().cast("array<string>"))
    kind = F.when(listed, F.coalesce(_said(b, KIND), F.lit("paragraph"))).otherwise("paragraph")
    block_id = F.when(listed, named).otherwise(F.col("key"))
    text = F.when(listed, F.coalesce(_said(b, TEXT), F.lit(""))).otherwise(F.coalesce(F.try_variant_get(b, "$", "string"), F.lit("")))
    return each.where(~listed | is_object).select(
        "file", (F.col("pos") + 1).cast("long").alias("pos"), block_id.alias("block_id"), kind.alias("kind"), text.alias("text"),
        F.when(listed, media).otherwise(F.array().cast("array<string>")).alias("media"), (listed & ((kind == "image") | block_id.startswith("img"))).alias("is_image"),
    )


def spellings(block_id: Column) -> Column:
    """All ids that an id may stand for, itself first: b0001, p-0001, p0001 and 1; img0001 and img-0001."""
    digits = lambda p: F.regexp_replace(F.regexp_extract(block_id, p, 1), "^0+(?=.)", "")
    as_b, as_p, as_img = digits(r"^b(\d+)$"), digits(r"^p-?(\d+)$"), digits(r"^img-?(\d+)$")
    more = (
        F.when(as_b != "", F.array(F.concat(F.lit("p-"), padded(as_b)), F.concat(F.lit("p"), padded(as_b)), as_b))
        .when(as_p != "", F.array(F.concat(F.lit("b"), padded(as_p)), F.concat(F.lit("p-"), padded(as_p))))
        .when(as_img != "", F.array(F.concat(F.lit("img"), padded(as_img)), F.concat(F.lit("img-"), padded(as_img))))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.array_distinct(F.concat(F.array(block_id), more))


def resolved(asked: DataFrame, known: DataFrame, file: str, block_id: str) -> DataFrame:
    """`asked` (file, id and more) with found, the known id (file, block_id) that it stands for, the earliest spelling first; null where none does.

    Every spelling meets the known ids in one equi-join; the best one is kept by an aggregate over a row's own few spellings.
    """
    rows = asked.withColumn("__all", spellings(F.col(block_id)))
    pairs = rows.select(F.col(file).alias("__file"), F.col(block_id).alias("__asked"), F.posexplode("__all").alias("__rank", "__id")).distinct()
    have = known.select(F.col("file").alias("__file"), F.col("block_id").alias("__id")).distinct()
    best = pairs.join(have, ["__file", "__id"]).groupBy("__file", "__asked").agg(F.min_by("__id", "__rank").alias("found"))
    return rows.drop("__all").join(best, (F.col(file) == F.col("__file")) & (F.col(block_id) == F.col("__asked")), "left").drop("__file", "__asked")
