"""Tables kept up with a stream of changes: each batch recomputes what it touches and writes only what differs."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threadloom.operators import merges, rollups
from threadloom.streaming.versions import Pointer, Versions, upsert_buckets


SUMMARY_KEYS = ["user_id", "thread_id"]


def reconcile(messages: DataFrame, versions: Versions, checkpoint: str, base: Callable[[], DataFrame], buckets: int = 64) -> None:
    """Follow a stream of messages with the thread summaries of ``base()``, all that has come since the last stop, and return.

    The threads a batch touches are summed up anew from the base table, so late and repeated
    messages, a repeated batch and a new checkpoint do no harm; the buckets of those
    that differ are replaced.  Threads that the table lacks (their batch came under
    another checkpoint, say) are made good at the end.
    """

    def batch(touched: DataFrame, number: int) -> None:
        write_summaries(versions, rollups.thread_summary_incremental(base(), touched.select(*SUMMARY_KEYS).distinct()), buckets)

    messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    now = versions.current()
    if now is not None:
        missing = base().select(*SUMMARY_KEYS).distinct().join(now[1], SUMMARY_KEYS, "left_anti")
        write_summaries(versions, rollups.thread_summary_incremental(base(), missing), buckets)


def write_summaries(versions: Versions, fresh: DataFrame, buckets: int) -> None:
    """Replace the buckets in which a summary differs from the table in any compared column."""
    now = versions.current()
    changed = fresh if now is None else rollups.merge_changed(now[1], fresh, SUMMARY_KEYS, rollups.SUMMARY_COLUMNS)
    changed = changed.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        upsert_buckets(versions, changed, SUMMARY_KEYS, buckets, lambda old, new: new if old is None else merges.upsert(old, new, SUMMARY_KEYS))
    finally:
        changed.unpersist()


class Runs:
    """Additive counts of a stream: each batch adds a run, runs are added up when there are too many, all is counted anew when it is old."""

    def __init__(self, versions: Versions, key: str, most: int = 40):
        self.versions, self.key, self.most = versions, key, most

    def add(self, counts: DataFrame, source: str, batch: int) -> bool:
        """Keep a batch's (key, n) unless that batch of ``source`` is in; says whether it was new."""
        before = self.versions.pointer()
        if before.done.get(source, -1) >= batch:
            return False
        run = max(before.buckets, default=-1) + 1
        before = self.versions.publish(counts, F.lit(run), [run], before, source, batch, spread=self.key)
        if len(before.buckets) > self.most:
            now = self.versions.pointer()
            self.versions.publish(self.counts(), F.lit(run + 1), [*now.buckets, run + 1], now, spread=self.key)
        return True

    def rebuild(self, counts: DataFrame, source: str, batch: int) -> None:
        """Replace all runs by ``counts`` of everything up to ``batch``."""
        now = self.versions.pointer()
        run = max(now.buckets, default=-1) + 1
        self.versions.publish(counts, F.lit(run), [*now.buckets, run], now, source, batch, spread=self.key)

    def counts(self) -> DataFrame:
        """All runs as one."""
        return self.versions.current()[1].groupBy(self.key).agg(F.sum("n").alias("n"))

    def follow(self, stream: DataFrame, checkpoint: str) -> None:
        """Add the rows that have come, batch by batch, and return; batches are known by the checkpoint's own id."""

        def batch(rows: DataFrame, number: int) -> None:
            told = rows.sparkSession.read.text(f"{checkpoint}/metadata").first()[0]
            self.add(rows.groupBy(self.key).agg(F.count(F.lit(1)).alias("n")), json.loads(told)["id"], number)

        stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def refresh_index(versions: Versions, rows: DataFrame, id: str, size: int, most_stale: float = 0.02) -> Pointer:
    """Bring an index in buckets of ``size`` ids up to ``rows``: only buckets that differ are written, their files alone are new.

    Buckets are compared by count and digests, not row by row; where more than
    ``most_stale`` of the indexed rows are gone or differ, everything is written.
    """
    bucket = F.floor(F.col(id) / size).cast("int")

    def digests(df: DataFrame, name: str) -> DataFrame:
        row = F.xxhash64(*sorted(df.columns))
        return df.groupBy(bucket.alias("bucket")).agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).alias("sum"), F.bit_xor(row).alias("xor")).alias(name))

    before = versions.pointer()
    old = versions.read(before)
    if old is None:
        return versions.publish(rows, bucket, [r[0] for r in rows.select(bucket).distinct().collect()], before)
    both = digests(old, "was").join(digests(rows, "now"), "bucket", "full").where(~F.col("was").eqNullSafe(F.col("now"))).select("bucket").collect()
    touched = [r[0] for r in both]
    if not touched:
        return before
    own = versions.read(before, touched)
    row = lambda df: df.select(id, F.xxhash64(*sorted(df.columns)).alias("__row"))
    stale = 0 if own is None else row(own).join(row(rows), [id, "__row"], "left_anti").count()
    if stale > most_stale * old.count():
        touched = sorted({*before.buckets, *(r[0] for r in rows.select(bucket).distinct().collect())})
    return versions.publish(rows.where(bucket.isin(touched)), bucket, touched, before)


def replace_for_tenant(old: DataFrame, new: DataFrame, tenant: str = "user_id") -> DataFrame:
    """All rows of the tenants that ``new`` speaks for are its own; other tenants' stay."""
    return old.join(new.select(tenant).distinct(), tenant, "left_anti").select(old.columns).unionByName(new)


def replace_per_key(old: DataFrame, new: DataFrame, marks: DataFrame, done: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(table, marks) after the keys in ``done`` (key, ok) were worked on: a key that went well has its rows replaced and is
    marked, one that failed keeps its rows and stays pending."""
    well = done.where("ok").select(key).distinct()
    table = old.join(well, key, "left_anti").select(old.columns).unionByName(new.join(well, key, "left_semi").select(old.columns))
    return table, marks.select(key).union(well).distinct()


def conditional_upsert(old: DataFrame, new: DataFrame, key: str, owner: str, kept_if_null: tuple[str, ...] = ()) -> DataFrame:
    """Insert absent keys; update those of the same owner; a null in ``kept_if_null`` leaves the old value, others' rows stay."""
    fresh = new.select(F.col(key), F.lit(True).alias("__has"), *[F.col(c).alias(f"__new_{c}") for c in new.columns if c != key])
    both = old.withColumn("__there", F.lit(True)).join(fresh, key, "full")
    mine = F.col("__has") & (F.col("__there").isNull() | (F.col(owner) == F.col(f"__new_{owner}")))
    value = lambda c: F.coalesce(f"__new_{c}", c) if c in kept_if_null else F.col(f"__new_{c}")
    return both.select(key, *[F.when(mine, value(c)).otherwise(F.col(c)).alias(c) for c in old.columns if c != key])


def past_retention(rows: DataFrame, parents: DataFrame, key: str, at: str, now: Column, days: int, keep: int = 0, id: str = "id") -> DataFrame:
    """Rows whose parent is gone or that are older than ``days``, but for each parent's newest ``keep``; of one time the smaller id is newer."""
    nth = F.row_number().over(W.partitionBy(key).orderBy(F.desc(at), id))
    told = rows.withColumn("__nth", nth).join(parents.select(key, F.lit(True).alias("__has")).distinct(), key, "left")
    old = (F.col(at) < now - F.make_dt_interval(days=F.lit(days))) & (F.col("__nth") > keep)
    return told.where(F.col("__has").isNull() | old).select(rows.columns)


def fan_out(rows: DataFrame, made: DataFrame, key: str, column: str, id: str, owner: str, most: int) -> DataFrame:
    """(id, column) to write once ``made`` (id, key, column) has been worked out for some rows of a key.

    Each owner's share of a key is filled by one representative: the row that was worked on,
    else the smallest id; of the others at most ``most`` are filled too, by id, the rest stay open.
    """
    done = made.groupBy(key).agg(F.min_by(column, id).alias(column), F.min(id).alias("__stub"))
    open_rows = rows.join(done, key)
    nth = F.row_number().over(W.partitionBy(key, owner).orderBy((F.col(id) != F.col("__stub")).cast("int"), id))
    return open_rows.withColumn("__nth", nth).where(F.col("__nth") <= most + 1).select(id, owner, (F.col("__nth") == 1).alias("representative"), column)


def backfilled(rows: DataFrame, column: str, value: Column, key: str, chunk: int, low: int, high: int) -> DataFrame:
    """The rows of one chunk of keys that a backfill has to write: those whose column is still null, filled; ``low`` and ``high`` bound the run."""
    return rows.where((F.col(key) >= low) & (F.col(key) < high) & F.col(column).isNull()).withColumn(column, value).withColumn("chunk", F.floor((F.col(key) - low) / chunk))


def backfill_chunks(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(chunk, low, high, n): ranges of an integer key to work through one by one; a chunk is its key divided by ``size``."""
    return rows.groupBy(F.floor(F.col(key) / size).alias("chunk")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n"))


def reindex_triggers(stream: DataFrame, key: str, least: int, wait_ms: int) -> DataFrame:
    """(key, n, reason) each time a key has ``least`` new rows, or has any and ``wait_ms`` have gone by since the first of them."""
    kind = stream.schema[key].dataType.simpleString()

    def run(group, batches, state: GroupState):
        seen = state.get[0] if state.exists else 0
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [group[0]], "n": [seen], "reason": ["age"]})
            return
        seen += sum(len(b) for b in batches)
        if seen >= least:
            if state.exists:
                state.remove()
            yield pd.DataFrame({key: [group[0]], "n": [seen], "reason": ["count"]})
            return
        if seen:
            first = not state.exists
            state.update((seen,))
            if first:
                state.setTimeoutDuration(wait_ms)

    return stream.select(key).groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, n long, reason string", "seen long", "append", GroupStateTimeout.ProcessingTimeTimeout)
