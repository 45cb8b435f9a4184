"""Job and run events as streams: replay from a checkpoint, idempotent ledger, latest state.

Delivery is at least once; the ledger is keyed by run and index, so its content is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def replay(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Events in files, read once each; the checkpoint of the query is the offset."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_ledger(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch in a folder of its own that a retry overwrites; read with ledger()."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return events.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ledger(spark: SparkSession, path: str, keys: list[str], order: str) -> DataFrame:
    """The last event of each key."""
    rows = spark.read.parquet(path).drop("batch")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("e"))
    return last.select(*keys, "e.*")


def fold_stream(events: DataFrame, job: str, order: str, fields: list[str]) -> DataFrame:
    """Latest non-null value of each field, for complete or update mode."""
    latest = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    return events.groupBy(job).agg(F.count(F.lit(1)).alias("events"), F.max(order).alias("last"), *latest)


def windowed(events: DataFrame, ts: str = "ts", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and sums by day and type; events later than `late` are left out."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
