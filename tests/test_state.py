"""Heartbeats by time alone, and what comes late."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from threadloom.operators import spelling
from threadloom.streaming import state, upkeep
from threadloom.streaming.windows import drained


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def test_jobs_end_by_word_or_by_time(spark, tmp_path):
    """Files come one by one; a job without another heartbeat is stopped when time has gone on elsewhere."""
    home, schema = str(tmp_path / "in"), "job string, at timestamp, status string"

    def write(*rows):
        spark.createDataFrame([(j, f"2024-01-01 00:{m:02}:00", s) for j, m, s in rows], "job string, at string, status string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(home)

    def run():
        beats = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(home)
        with state.kept_in_rocksdb(spark):
            got = drained(state.followed(beats, "job", "at", "status", 10 * 60_000, late="1 minute").select("job", F.date_format("at", "mm").alias("at"), "status", "detail"), str(tmp_path / "state"))
        return sorted((r["job"], r["at"], r["status"], r["detail"]) for r in got.collect())

    write(("a", 0, "running"), ("b", 0, "running"), ("c", 1, "running"))
    assert run() == []
    write(("b", 5, "running"), ("c", 6, "done"), ("b", 4, "running"))
    assert run() == [("c", "06", "done", None)]
    write(("d", 13, "running"))
    write(("a", 2, "running"))  # too late to count: time has passed it
    gone = ("a", "10", "stopped", state.REAPED)
    assert run() == [gone, ("c", "06", "done", None)]
    write(("d", 30, "running"), ("a", 31, "running"))
    found = run()
    assert ("b", "15", "stopped", state.REAPED) in found and ("d", "23", "stopped", state.REAPED) in found and found.count(gone) == 1


def test_reindex_by_age(spark, tmp_path):
    """A key with few new rows fires once they have waited long enough, at the next batch of whatever key."""
    home = str(tmp_path / "in")

    def run():
        stream = spark.readStream.schema("k string").parquet(home)
        fired = upkeep.reindex_triggers(stream, "k", 5, 1500)
        fired.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start().awaitTermination()
        return sorted((r["k"], r["n"], r["reason"]) for r in spark.read.schema("k string, n long, reason string").parquet(str(tmp_path / "out")).collect())

    write = lambda *keys: spark.createDataFrame([(k,) for k in keys], "k string").coalesce(1).write.mode("append").parquet(home)
    write(*"aabbbbb")
    assert run() == [("b", 5, "count")]
    time.sleep(2)
    write("c")
    assert run() == [("a", 2, "age"), ("b", 5, "count")]


def test_spelling(spark):
    words = spark.createDataFrame([(w,) for w in ("hause", "hosue", "mice", "ab", "x:yz", "house", "zzzzz", "hous", "miec", "mce")], "word string")
    known = spark.createDataFrame([("house", 5), ("horse", 9), ("mouse", 7), ("mice", 2), ("nice", 2)], "word string, n long")
    got = {r["word"]: (r["fixed"], r["edits"]) for r in spelling.corrected(words, known).collect()}
    assert got == {"hause": ("house", 1), "hosue": ("horse", 2), "hous": ("house", 1), "miec": ("mice", 2), "mce": ("mice", 1)}
