"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from sheafline.scratch import shared_dir

#: Where set, Spark drops a query's shuffle files once the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, path: str) -> DataFrame:
    """Writes `df` to `path` and reads it back; its shuffle files go as soon as it is written."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    if spark.conf.isModifiable(_CLEANUP):
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is not None:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder and read back (compressed, with known sizes)."""
    return saved(df, f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}")


def dropped(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:  # its own folder, or those it is derived from
            if "/table-" not in path:
                continue
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, rows: int) -> bool:
    """Whether a written table has at most `rows` rows (answered from Parquet footers)."""
    return df.count() <= rows


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, tables that are written go through Python `rows` rows at a time, or as many as the session says if fewer.

    A batch stands in Python's memory and, with room to grow, in the executor's beside its heap.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
