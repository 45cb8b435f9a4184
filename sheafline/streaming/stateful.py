"""Jobs and runs as keyed state in streams: folded fields and logs, resume timers, net state under retractions.

A key is a job or a run, so state is spread by it and one key's events are folded in their order, whatever
micro-batches they come in. State lives in the state store (RocksDB) and its checkpoint: a stopped stream
goes on where it was, timers included. Events of a key must not come in an earlier micro-batch than those
before them; inside a batch they are put in order.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator
from functools import cache
from itertools import groupby
from operator import attrgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

_PROVIDER = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
#: States that end a job, the least delay of a resumption in seconds.
TERMINAL = ("completed", "failed", "cancelled")
LEAST_DELAY = 30
#: Indexes of a run whose kinds are one row of state.
BLOCK = 64

#: What a job event has: kind is emit, complete, fail or cancel.
JOB_EVENT = "job long, seq long, kind string, stage string, progress int, eta int, grp string, message string, warning string, result string"
JOB_STATE = "seq long, status string, stage string, progress int, eta int, grp string, step string, result string, error string, cancel boolean, n_logs long, n_warnings long"
JOB_ROW = f"job long, {JOB_STATE}, logs array<string>"


def started(stream: DataFrame, sink, checkpoint: str, mode: str = "update", partitions: int | None = None, **trigger) -> StreamingQuery:
    """Starts `stream` into `sink(batch, id)` with the state store that keyed state needs.

    `partitions` of the state are fixed by the first start; if not given they are spark.sql.shuffle.partitions, but no more than
    two for each core, as every one of them starts a store and a worker in each batch.
    """
    conf = stream.sparkSession.conf
    most = 2 * stream.sparkSession.sparkContext.defaultParallelism
    partitions = partitions or min(int(conf.get("spark.sql.shuffle.partitions")), most)
    settings = _PROVIDER | {"spark.sql.shuffle.partitions": str(partitions)}
    before = {k: conf.get(k, None) for k in settings}
    for k, v in settings.items():
        conf.set(k, v)
    try:
        return stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def into_folders(path: str):
    """A sink that writes each batch to a folder of its own; a repeated batch replaces its folder."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return save


def _value(x):
    """None for what pandas made of a null."""
    return None if x is None or (not isinstance(x, (list, str)) and pd.isna(x)) else x


@cache
def _event(columns: tuple[str, ...]) -> type:
    """The named tuple of a row; itertuples() would make a new class for each frame."""
    return namedtuple("Event", columns)


def _sorted(rows: Iterator[pd.DataFrame], *by: str) -> list:
    """Rows of a key as named tuples in order; a frame for each key is costly to join and sort, so they are sorted as tuples."""
    return sorted((e for pdf in rows for e in map(_event(tuple(pdf.columns))._make, zip(*(pdf[c] for c in pdf.columns)))), key=attrgetter(*by))


class JobFold(StatefulProcessor):
    """The latest value of each field of a job in value state, its log lines and warnings in list state.

    A row goes out for each job that a batch touches. The log goes out, and leaves the state, with the
    batch that ends the job; lines that come later are kept for the next end.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fields", JOB_STATE)
        self.logs = handle.getListState("logs", "line string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seq, status, stage, progress, eta, grp, step, result, error, cancel, n_logs, n_warnings = (
            self.state.get() or (None, "queued", None, 0, None, None, None, None, None, False, 0, 0)
        )
        lines, ended = [], False
        for e in _sorted(rows, "seq"):
            seq, kind, message = int(e.seq), e.kind, _value(e.message)
            if kind == "cancel":
                cancel = True
                if status in TERMINAL:
                    continue
                message = "cancel requested"
            elif kind == "complete":
                status, progress, ended, message = "completed", 100, True, "job completed"
                result = _value(e.result) or result
            elif kind == "fail":
                status, progress, ended, error = "failed", 100, True, message
            else:
                status = "running" if status == "queued" else status
                stage, grp, result = _value(e.stage) or stage, _value(e.grp) or grp, _value(e.result) or result
                progress = progress if _value(e.progress) is None else max(0, min(100, int(e.progress)))
                eta = eta if _value(e.eta) is None else max(0, int(e.eta))
                n_warnings += bool(_value(e.warning))
            step = message
            lines.append((message,))
        n_logs += len(lines)
        fields = (seq, status, stage, progress, eta, grp, step, result, error, cancel, n_logs, n_warnings)
        self.state.update(fields)
        if lines:
            self.logs.appendList(lines)
        log = None
        if ended:
            log = [line for (line,) in self.logs.get()]
            self.logs.clear()
        yield pd.DataFrame([(key[0], *fields, log)], columns=[c.split()[0] for c in JOB_ROW.split(", ")]).astype({"eta": "Int32", "progress": "Int32"})

    def close(self) -> None:
        pass


def job_states(events: DataFrame) -> DataFrame:
    """JOB_ROW of every job that a micro-batch of JOB_EVENT rows touches, in update mode."""
    return events.groupBy("job").transformWithStateInPandas(JobFold(), outputStructType=JOB_ROW, outputMode="Update", timeMode="None")


class Resumption(StatefulProcessor):
    """Arms a timer where a run needs to be resumed, fires it once it is due, clears it where the need ends.

    A due time that lies before the next event of the run fires with that event, all others when the
    watermark passes them, so firings do not depend on how events are cut into batches.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("armed", "due long, attempts int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due, attempts = self.state.get() or (-1, 0)
        armed, fired = due, []
        for e in _sorted(rows, "at", "seq"):
            at = int(e.at)
            if 0 <= due <= at:
                attempts += 1
                fired.append((key[0], due, attempts))
                due = -1
            if not e.needs:
                due = -1
            elif due < 0:
                due = at + 1000 * max(LEAST_DELAY, int(e.delay))
        if armed != due:
            if armed >= 0:
                self.handle.deleteTimer(armed)
            if due >= 0:
                self.handle.registerTimer(due)
        self.state.update((due, attempts))
        yield pd.DataFrame(fired, columns=["run", "due", "attempt"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, attempts = self.state.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if due == at:
            self.state.update((-1, attempts + 1))
            yield pd.DataFrame([(key[0], at, attempts + 1)], columns=["run", "due", "attempt"])

    def close(self) -> None:
        pass


def resume_firings(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(run, due, attempt) of events (run, seq, at, needs, delay in seconds); times are milliseconds since 1970."""
    timed = events.withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", late).groupBy("run")
    return timed.transformWithStateInPandas(Resumption(), outputStructType="run long, due long, attempt int", outputMode="Append", timeMode="EventTime")


class NetRun(StatefulProcessor):
    """Counts of the net events of a run: a later event on an index takes back what the one before it added.

    Every read or write of state is a call to the JVM, so kinds are kept by blocks of indexes: one call reads what a
    batch needs of a block and one writes it, however long the run is.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kinds = handle.getMapState("kinds", "block long", "kinds array<string>")
        self.state = handle.getValueState("net", "uploaded long, skipped long, undone long, top long, last string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get()
        uploaded, skipped, undone, top, last = known or (0, 0, 0, -1, None)
        n = {"uploaded": uploaded, "skipped": skipped, "undone": undone}
        changed: dict[int, str] = {}
        for e in _sorted(rows, "seq"):
            changed[int(e.index_)] = e.kind
            last = e.kind
        for block, indexes in groupby(sorted(changed), key=lambda index: index // BLOCK):
            (kinds,) = known and self.kinds.getValue((block,)) or ([None] * BLOCK,)
            before = list(kinds)
            for index in indexes:
                was, kind = kinds[index % BLOCK], changed[index]
                if was != kind:
                    if was:
                        n[was] -= 1  # the retraction
                    n[kind] += 1
                    kinds[index % BLOCK] = kind
                if kind != "undone":
                    top = max(top, index)
            if kinds != before:
                self.kinds.updateValue((block,), (kinds,))
        if changed.get(top) == "undone":  # the last one is lost
            top = max((block * BLOCK + i for (block,), (kinds,) in self.kinds.iterator() for i, kind in enumerate(kinds) if kind not in (None, "undone")), default=-1)
        self.state.update((n["uploaded"], n["skipped"], n["undone"], top, last))
        yield pd.DataFrame(
            [(key[0], n["uploaded"], n["skipped"], n["undone"], top + 1 if top >= 0 else None, last)], columns=["run", "uploaded", "skipped", "undone", "next_index", "last_kind"]
        )

    def close(self) -> None:
        pass


def net_runs(events: DataFrame) -> DataFrame:
    """(run, uploaded, skipped, undone, next_index, last_kind) of every run that a batch of (run, seq, index_, kind) touches."""
    schema = "run long, uploaded long, skipped long, undone long, next_index long, last_kind string"
    return events.groupBy("run").transformWithStateInPandas(NetRun(), outputStructType=schema, outputMode="Update", timeMode="None")


def in_steps(rows: DataFrame, path: str, step: Column, steps: int) -> list[DataFrame]:
    """`rows` cut by `step` (0 to steps - 1); each part is written to `path` by the caller in order, side by side in as many files as tasks."""
    return [rows.where(step == i) for i in range(steps)]


def restarted(spark: SparkSession, rows: DataFrame, step: Column, steps: int, transform, path: str, partitions: int | None = None) -> DataFrame:
    """Runs `transform` over `rows` as a stream that stops after every step and goes on from its checkpoint; its output with batch."""
    schema = rows.schema
    for part in in_steps(rows, path, step, steps):
        part.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{path}/in")  # all new files, which are those of the step, make one batch
        started(transform(stream), into_folders(f"{path}/out"), f"{path}/offsets", partitions=partitions).awaitTermination()
    return spark.read.parquet(f"{path}/out")
