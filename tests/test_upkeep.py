"""Tables kept up by streams: nothing is lost by new checkpoints, failed writes, late rows or other writers."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from threadloom.sources.tail import LineTail
from threadloom.streaming import upkeep
from threadloom.streaming.versions import Reader, Taken, Versions, upsert_buckets


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


MESSAGE = "user_id string, thread_id string, id string, date string, subject string, from_addr string, labels array<string>"


def _mail(spark, ids, date="2024-01-0"):
    rows = [(f"u{i % 2}", f"t{i % 7}", str(i), f"{date}{i % 9}", f"s{i}", f"a{i % 3}", ["INBOX"]) for i in ids]
    return spark.createDataFrame(rows, MESSAGE).coalesce(1)


def _counts(df):
    return {(r["user_id"], r["thread_id"]): r["message_count"] for r in df.collect()}


def test_reconciler_loses_nothing(spark, tmp_path, monkeypatch):
    base, versions = str(tmp_path / "base"), Versions(spark, str(tmp_path / "sums"))
    read = lambda: spark.read.schema(MESSAGE).parquet(base)

    def run(checkpoint):
        stream = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).parquet(base)
        upkeep.reconcile(stream, versions, str(tmp_path / checkpoint), read, buckets=4)
        want = {(r["user_id"], r["thread_id"]): r["n"] for r in read().groupBy("user_id", "thread_id").agg(F.count("id").alias("n")).collect()}
        assert _counts(versions.current()[1]) == want

    for k in range(3):
        _mail(spark, range(50 * k, 50 * k + 50)).write.mode("append").parquet(base)
        run("one")
    _mail(spark, range(200, 230)).write.mode("append").parquet(base)
    run("two")  # batch 0 of a new checkpoint
    _mail(spark, [500], date="2020-01-0").write.mode("append").parquet(base)  # late
    run("two")
    number, files = versions.pointer().number, set(os.listdir(tmp_path / "sums/data"))
    run("three")  # all of it again
    assert versions.pointer().number == number and set(os.listdir(tmp_path / "sums/data")) == files
    _mail(spark, [600]).write.mode("append").parquet(base)
    create = Versions._create
    monkeypatch.setattr(Versions, "_create", lambda *a: 1 / 0)
    with pytest.raises(Exception, match="division"):
        run("two")
    monkeypatch.setattr(Versions, "_create", create)
    assert versions.pointer().number == number
    run("two")


def test_only_buckets_that_change_are_written(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "index"))
    rows = spark.range(400).select("id", (F.col("id") * 2).alias("x"))
    upkeep.refresh_index(versions, rows, "id", 50)
    files = {f: os.stat(f).st_mtime_ns for d, _, names in os.walk(tmp_path / "index/data") for f in (f"{d}/{n}" for n in names)}
    reader = Reader(versions)
    first = reader.table()
    changed = rows.where("id <> 60").withColumn("x", F.when(F.col("id") == 61, 0).otherwise(F.col("x"))).union(spark.range(400, 401).select("id", F.lit(1)))
    now = upkeep.refresh_index(versions, changed, "id", 50)
    assert {b for b in now.buckets if now.made_by(b) == 1} == {1, 8} and sorted(map(tuple, reader.table().collect())) == sorted(map(tuple, changed.collect()))
    assert {f: os.stat(f).st_mtime_ns for f in files} == files and first.count() == 400
    assert upkeep.refresh_index(versions, changed, "id", 50).number == 1  # nothing differs
    assert versions.clean(keep=1) == []
    whole = upkeep.refresh_index(versions, changed.withColumn("x", F.lit(7)), "id", 50)
    assert {whole.made_by(b) for b in whole.buckets} == {2}
    gone = versions.clean(keep=0)
    assert len(gone) == 10 and len(os.listdir(tmp_path / "index/data")) == 1 and versions.current()[1].count() == 400
    assert versions.clean(keep=0) == []
    less = upkeep.refresh_index(versions, changed.withColumn("x", F.lit(7)).where("id >= 50"), "id", 50, most_stale=1.0)
    assert 0 not in less.buckets and versions.current()[1].count() == 350


def test_second_writer_goes_again(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "t"))
    one = lambda k: spark.createDataFrame([(k, 1)], "k long, n long")
    other = Versions(spark, str(tmp_path / "t"))
    stale = versions.pointer()
    other.publish(one(1), F.lit(0), [0], stale)
    with pytest.raises(Taken):
        versions.publish(one(2), F.lit(0), [0], stale)
    assert versions.current()[1].collect()[0]["k"] == 1
    raced = []

    def merge(old, fresh):
        if not raced:
            raced.append(1)
            upsert_buckets(other, one(3), ["k"], 1, lambda o, f: f if o is None else o.union(f))
        return fresh if old is None else old.union(fresh)

    upsert_buckets(versions, one(4), ["k"], 1, merge)
    assert sorted(r["k"] for r in versions.current()[1].collect()) == [1, 3, 4]


def test_runs(spark, tmp_path):
    runs = upkeep.Runs(Versions(spark, str(tmp_path / "runs")), "w", most=3)
    counts = lambda **n: spark.createDataFrame(list(n.items()), "w string, n long")
    for k in range(8):
        assert runs.add(counts(a=1, b=k), "s", k)
        assert len(runs.versions.pointer().buckets) <= 3
    assert not runs.add(counts(a=100), "s", 5) and runs.add(counts(c=1), "other", 0)
    assert {r["w"]: r["n"] for r in runs.counts().collect()} == {"a": 8, "b": 28, "c": 1}
    runs.rebuild(counts(a=2), "s", 9)
    assert {r["w"]: r["n"] for r in runs.counts().collect()} == {"a": 2} and not runs.add(counts(a=1), "s", 9)


def test_lines_are_whole(spark, tmp_path):
    home = tmp_path / "in"
    home.mkdir()
    spark.dataSource.register(LineTail)

    def lines():
        stream = spark.readStream.format("line_tail").option("path", f"file://{home}").option("range", 5).load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["file"], r["at"], r["line"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (home / "a").write_bytes(b"one\ntw")
    (home / "b").write_bytes("é".encode()[:1])
    assert lines() == [("a", 0, "one")]
    with open(home / "a", "ab") as f:
        f.write(b"o\r\n\nlong line over ranges\n")
    with open(home / "b", "ab") as f:
        f.write("é".encode()[1:] + b"\nlast")
    want = [("a", 0, "one"), ("a", 4, "two"), ("a", 9, ""), ("a", 10, "long line over ranges"), ("b", 0, "é")]
    assert lines() == want and lines() == want
    (home / "a").write_bytes(b"new\n")
    assert lines() == sorted([*want, ("a", 0, "new")])
