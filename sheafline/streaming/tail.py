"""Following events until their jobs have ended, and cancelling work by tag."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: Fixed value: a tail ends after half an hour at the latest.
MAX_AGE = 1800.0


class Drained(StreamingQueryListener):
    """Tells when a query has seen the end of so many jobs and then finds nothing more to read.

    The ends are counted by the query itself (a metric observed in each batch), so no event reaches the driver.
    """

    def __init__(self, jobs: int):
        self.jobs, self.ended, self.drained = jobs, 0, threading.Event()
        self.id: str | None = None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if self.id is None or str(event.progress.id) == self.id:
            seen = (event.progress.observedMetrics or {}).get("tail")
            self.ended += int(seen["ended"] or 0) if seen is not None else 0
            if event.progress.numInputRows == 0:
                self._rest()

    def onQueryIdle(self, event) -> None:
        if self.id is None or str(event.id) == self.id:
            self._rest()

    def _rest(self) -> None:
        if self.ended >= self.jobs:
            self.drained.set()

    def onQueryTerminated(self, event) -> None:
        if self.id is None or str(event.id) == self.id:
            self.drained.set()


def tail(events: DataFrame, ends: Column, jobs: int, sink: Callable[[DataFrame, int], None], checkpoint: str, *, max_age: float = MAX_AGE, poll: str = "500 milliseconds") -> bool:
    """Follows `events` into `sink` until `jobs` rows with `ends` were read and nothing more is there; False if `max_age` seconds came first.

    What arrives after an end but before the source is drained is read, too.
    """
    spark = events.sparkSession
    told = Drained(jobs)
    spark.streams.addListener(told)
    began = time.monotonic()
    query: StreamingQuery | None = None
    try:
        watched = events.observe("tail", F.count_if(ends).alias("ended"))
        query = watched.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=poll).start()
        told.id = str(query.id)
        while not told.drained.wait(0.1) and time.monotonic() - began < max_age:
            if query.exception() is not None:
                raise query.exception()
        return told.ended >= jobs
    finally:
        if query is not None:
            query.stop()
        spark.streams.removeListener(told)


def after(events: DataFrame, index: str, offset: int) -> DataFrame:
    """The events from an offset on."""
    return events.where(F.col(index) >= offset)


def tagged(spark: SparkSession, tag: str, work: Callable[[], object]) -> object:
    """Runs `work` so that cancel(spark, tag) from another thread ends its jobs."""
    spark.sparkContext.addJobTag(tag)
    try:
        return work()
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Cancels all running jobs with the tag, whichever thread started them."""
    spark.sparkContext.cancelJobsWithTag(tag)
