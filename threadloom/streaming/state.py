"""Streams that remember: heartbeats of jobs with timers, key-values that expire, sessions, and joins of two streams within an interval."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A job is alive for so long after a heartbeat, and stopped after so long without one (milliseconds of event time).
REAP_MS = 600_000
REAPED = "stale — process gone"


class Heartbeats(StatefulProcessor):
    """State of each job by its heartbeats (job, at, status): running ones are stopped when none has come for ``after_ms``.

    A timer is set behind each heartbeat of a running job and moved by the next, so a
    job is stopped by time alone, without another row of its own.  Heartbeats that come
    late, before the last one, change nothing.
    """

    def __init__(self, after_ms: int = REAP_MS):
        self.after_ms = after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, status = self.last.get() if self.last.exists() else (-1, None)
        out = []
        told = [pair for frame in rows for pair in zip(frame["at"].astype("datetime64[ms]").astype("int64").tolist(), frame["status"], strict=True)]
        for t, s in sorted(told, key=lambda pair: (pair[0], pair[1] == "running")):
            if t < at:
                continue
            if status == "running" and t - at > self.after_ms:  # it was gone before it came back
                out.append((key[0], at + self.after_ms, "stopped", REAPED))
            at, status = t, s
            if s != "running":
                out.append((key[0], t, s, None))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if at >= 0:
            self.last.update((at, status))
            if status == "running":
                self.handle.registerTimer(at + self.after_ms)
        yield pd.DataFrame(out, columns=["job", "at", "status", "detail"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, status = self.last.get()
        if status == "running" and expiredTimerInfo.getExpiryTimeInMs() >= at + self.after_ms:
            self.last.update((at, "stopped"))
            yield pd.DataFrame([(key[0], at + self.after_ms, "stopped", REAPED)], columns=["job", "at", "status", "detail"])

    def close(self) -> None:
        """Nothing is held outside the state."""


@contextlib.contextmanager
def kept_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """The store that timers and several kinds of state need, while streams are started in this block."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def followed(beats: DataFrame, job: str, at: str, status: str, after_ms: int = REAP_MS, late: str = "0 seconds") -> DataFrame:
    """(job, at, status, detail): each time a job ends, by its own word or for want of heartbeats, in event time."""
    kind = beats.schema[job].dataType.simpleString()
    rows = beats.withWatermark(at, late).select(F.col(job).alias("job"), F.col(at).alias("at"), F.col(status).alias("status"))
    found = rows.groupBy("job").transformWithStateInPandas(Heartbeats(after_ms), f"job {kind}, at long, status string, detail string", "Append", "EventTime")
    return found.select("job", F.timestamp_millis("at").alias("at"), "status", "detail")


def sessions(events: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, n) of each session that has closed: no event for ``gap``."""
    window = events.withWatermark(at, late).groupBy(key, F.session_window(at, gap)).agg(F.count(F.lit(1)).alias("n"))
    return window.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def within(left: DataFrame, right: DataFrame, key: str, at: str, before: str, left_late: str, right_late: str) -> DataFrame:
    """Pairs of two streams' rows of one key, the left at most ``before`` ahead of the right; rows that can pair no more leave the state."""
    a = left.withWatermark(at, left_late).alias("a")
    b = right.withWatermark(at, right_late).alias("b")
    near = F.expr(f"a.`{key}` = b.`{key}` AND b.`{at}` >= a.`{at}` AND b.`{at}` <= a.`{at}` + INTERVAL {before}")
    return a.join(b, near)
