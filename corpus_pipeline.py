"""Cleaning a corpus in five stages, each written as Parquet and read back by the next one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.llm import decontaminate, mixing, ngram_join, quality, secrets
from sheafline.llm._store import shared_dir, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the rule ensemble, fitted on labelled documents, predicts to be good.

    A null text is judged as an empty one, repeated rows alike; columns of any name come out as they were.
    """
    model = quality.fit(quality.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    whole = docs.select(F.struct("*").alias("__row"), F.col("text").alias("__text"))
    return quality.scored(whole, model, "__text").where("predicted = 1").select("__row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked by five-word shingles.

    Rows with equal ids and texts count once (of such rows the one with the smallest digest of all its columns
    stays, so that reruns agree); a document without an id is kept only where none of its
    group has one. Kept rows are found by their own key of 128 bits, since ids may be null or repeated.
    """
    found = ngram_join.near_duplicates(docs)
    kept = written(found.where("key = kept_key").groupBy(F.col("key").alias("__key")).agg(F.count(F.lit(1)).alias("__rows")))
    rows = docs.withColumn("__key", ngram_join.row_key())
    out = rows.join(kept.hint("shuffle_hash"), "__key")
    alone = out.where("__rows = 1").select(*docs.columns)
    if not kept.where("__rows > 1").head(1):
        return alone
    one = out.where("__rows > 1").groupBy("__key").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("r"))
    return alone.unionByName(one.select("r.*"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words a twentieth or more stand in benchmark windows.

    A text without words stays, repeated rows fare alike; columns of any name come out as they were.
    """
    whole = docs.select(F.struct("*").alias("__row"), F.col("doc_id").alias("__id"), F.col("text").alias("__text"))
    found = decontaminate.contamination(whole, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text="__text", doc_id="__id")
    return found.where(~F.col("contaminated")).select("__row.*")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret in the texts and counts n_chars anew; all documents stay, null and empty texts as they are."""
    out = secrets.redacted(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target and taken words (in place of columns named so)."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed),
]

#: The classifier is fitted and the join follows sampled paths: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
