"""Uploads as a sink: rows in order of their run, paced, committed as a whole, delivered at least once and kept once.

Tasks send their rows and write what they sent to files of their own; the driver's commit names
these files in one manifest, which makes them count. A write that fails, or a driver that dies before the commit,
leaves files that no manifest names. A repeated write sends rows again, as the other side may have them already; the ledger
keeps the first committed row of each (run, index).
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

from sheafline.operators.ledger import SPEEDS
from sheafline.operators.prefix import SIZE, running

NAME = "paced_upload"


def planned(rows: DataFrame, run: str, index: str, speed: Column, answer_s: float = 2.0, size: int = SIZE) -> DataFrame:
    """`rows` with seconds (what a row takes, a long pause after every so many included) and starts_at (seconds since its run began).

    `index` counts from 1 in each run. Starts are running sums in parts of a run, so a long run is no single task.
    """
    preset = lambda value: F.coalesce(*[F.when(speed == name, F.lit(float(value(p)))) for name, p in SPEEDS.items()])
    each = preset(lambda p: p[0]) + preset(lambda p: p[1]) + F.lit(answer_s)
    pause = F.when(F.col(index) % preset(lambda p: p[4]).cast("long") == 0, preset(lambda p: (p[2] + p[3]) / 2)).otherwise(0.0)
    d = running(rows.withColumn("seconds", each + pause), [run], index, sums={"__upto": F.col("seconds")}, size=size)
    return d.withColumn("starts_at", F.col("__upto") - F.col("seconds")).drop("__upto")


@dataclass
class Sent(WriterCommitMessage):
    file: str
    rows: int


class _Writer:
    """Writes a task's rows to a file of its own, which the commit names in a manifest."""

    def __init__(self, options: dict):
        self.path, self.crash = options["path"].rstrip("/"), options.get("crash")

    def _open(self, name: str):
        files, path = fs.FileSystem.from_uri(f"{self.path}/{name}")
        files.create_dir(path.rpartition("/")[0], recursive=True)
        return files, path

    def write(self, batches) -> Sent:
        name, rows, writer = f"part-{uuid.uuid4().hex}.parquet", 0, None
        files, path = self._open(f"rows/{name}")
        for batch in batches:
            if writer is None:
                writer = pq.ParquetWriter(path, batch.schema, filesystem=files)
            writer.write_batch(batch)
            rows += batch.num_rows
            if self.crash == "task" and rows:
                raise RuntimeError("the connection was lost")
        if writer is not None:
            writer.close()
        return Sent(name if writer is not None else "", rows)

    def _commit(self, messages, manifest: str) -> None:
        if self.crash == "driver":
            raise RuntimeError("the driver was lost before its commit")
        files, path = self._open(f"commits/{manifest}.json")
        with files.open_output_stream(path) as out:
            for m in messages:
                if m is not None and m.file:
                    out.write((json.dumps({"file": m.file, "rows": m.rows, "manifest": manifest}) + "\n").encode())

    def _drop(self, messages) -> None:
        for m in messages:
            if m is not None and m.file:
                files, path = self._open(f"rows/{m.file}")
                files.delete_file(path)


class BatchWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages) -> None:
        self._commit(messages, f"batch-{uuid.uuid4().hex}")

    def abort(self, messages) -> None:
        self._drop(messages)


class StreamWriter(_Writer, DataSourceStreamArrowWriter):
    """A micro-batch that is committed again replaces its manifest."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.query = options.get("query", "stream")

    def commit(self, messages, batchId) -> None:
        self._commit(messages, f"{self.query}-{batchId}")

    def abort(self, messages, batchId) -> None:
        self._drop(messages)


class PacedUpload(DataSource):
    """df.write.format("paced_upload").option("path", a folder that driver and executors share by an address that Arrow can open)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite) -> BatchWriter:
        return BatchWriter(dict(self.options))

    def streamWriter(self, schema, overwrite) -> StreamWriter:
        return StreamWriter(dict(self.options))


def in_order(rows: DataFrame, run: str, index: str) -> DataFrame:
    """Each run in one task, in its order, many runs side by side."""
    return rows.repartition(run).sortWithinPartitions(run, index)


def upload(rows: DataFrame, path: str, run: str, index: str, **options: str) -> None:
    rows.sparkSession.dataSource.register(PacedUpload)
    in_order(rows, run, index).write.format(NAME).mode("append").options(path=path, **options).save()


def sent(spark: SparkSession, path: str) -> DataFrame:
    """Every row of every commit with manifest; a repeated upload is there twice.

    Only files that a manifest names are opened, as others may be broken; their names are what a reader's driver lists anyway.
    """
    named = spark.read.schema("file string, rows long, manifest string").json(f"{path}/commits")
    files = [f"{path}/rows/{r.file}" for r in named.select("file").distinct().collect()]
    rows = spark.read.parquet(*files)
    return rows.withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).join(named.drop("rows"), "file").drop("file")


def ledger(spark: SparkSession, path: str, run: str, index: str) -> DataFrame:
    """One row for each (run, index)."""
    rows = sent(spark, path)
    kept = [c for c in rows.columns if c not in (run, index, "manifest")]
    first = rows.groupBy(run, index).agg(F.min_by(F.struct(*kept), "manifest").alias("r"), F.count(F.lit(1)).alias("times"))
    return first.select(run, index, "r.*", "times")
