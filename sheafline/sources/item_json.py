"""Item files in JSON: shapes told apart by their keys, broken files kept as rows.

Whole files are parsed once into VARIANT; what is missing is null, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, value, doc): doc is null where the file is no JSON."""
    raw = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_name").alias("file"), "value", F.try_parse_json("value").alias("doc"))


def listed(files: DataFrame) -> DataFrame:
    """Item files by name, without those that hold reviews, reports or sources."""
    return files.where(~F.col("file").rlike(r"_(review|report|source)\.json$")).orderBy("file")


def _get(doc: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(doc, path, kind)


def shape(doc: Column) -> Column:
    """list, clean, group, markup, questions or invalid."""
    has = lambda path: F.try_variant_get(doc, path, "variant").isNotNull()
    first = "$.questions[0]"
    by_ids = has(f"{first}.question_block_ids") | has(f"{first}.option_block_ids")
    return (
        F.when(doc.isNull(), "invalid")
        .when(F.schema_of_variant(doc).startswith("ARRAY"), "list")
        .when(has("$.items"), "clean")
        .when(~has("$.quiz_title") & has("$.name") & has(f"{first}.correct"), "group")
        .when(~has(f"{first}.question") & by_ids, "markup")
        .when(has("$.questions"), "questions")
        .otherwise("invalid")
    )


#: An answer is one index, a list of them, or nothing.
def answers(item: Column, path: str = "$.correct") -> Column:
    many = _get(item, path, "array<int>")
    one = _get(item, path, "int")
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<int>"))


def questions(files: DataFrame) -> DataFrame:
    """(file, pos, question, options, answers, answers_is_list, explanation, context, media), one-based."""
    kind = shape(F.col("doc"))
    inside = F.when(kind == "list", _get(F.col("doc"), "$", "array<variant>")).when(kind == "clean", _get(F.col("doc"), "$.items", "array<variant>")).otherwise(
        _get(F.col("doc"), "$.questions", "array<variant>")
    )
    each = files.withColumn("shape", kind).select("file", "shape", F.posexplode(inside).alias("pos", "item"))
    item = F.col("item")
    base = F.when(F.col("shape") == "group", 1).otherwise(0)  # groups count from zero
    texts = F.coalesce(_get(item, "$.options", "array<string>"), F.transform(_get(item, "$.options", "array<variant>"), lambda o: _get(o, "$.text", "string")))
    found = F.when(F.col("shape") == "clean", answers(item, "$.answers")).otherwise(answers(item))
    return each.select(
        "file",
        (F.col("pos") + 1).alias("pos"),
        F.coalesce(_get(item, "$.type", "string"), F.lit("question")).alias("type"),
        _get(item, "$.question", "string").alias("question"),
        texts.alias("options"),
        F.transform(found, lambda a: a + base).alias("answers"),
        (_get(item, "$.correct", "array<int>").isNotNull() | (F.size(found) > 1)).alias("answers_is_list"),
        _get(item, "$.explanation", "string").alias("explanation"),
        F.coalesce(_get(item, "$.context", "string"), _get(item, "$.text", "string")).alias("context"),
        _get(item, "$.media", "array<string>").alias("media"),
    )


def invalid(files: DataFrame) -> DataFrame:
    """One issue for each file that cannot be read."""
    code = F.when(F.col("doc").isNull(), "invalid_json").when(shape(F.col("doc")) == "invalid", "invalid_schema")
    return files.select("file", code.alias("code")).where("code IS NOT NULL")
