"""Queries for what keeps tables up: replacements, conditional merges, retention, delta indexes and streams, with their DuckDB SQL."""

from __future__ import annotations

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.operators import models, rollups, search
from threadloom.plans.registry import Registry
from threadloom.sources import history
from threadloom.sources.mail import table
from threadloom.sources.tail import LineTail
from threadloom.streaming import upkeep
from threadloom.streaming.folders import new_folder
from threadloom.streaming.versions import Versions

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.oracle
#: About how many messages ask for one more file in each batch of a stream.
MESSAGES_PER_FILE = 4_000


@_R.query("SELECT o_orderkey, o_custkey % 3 AS tenant, o_totalprice * CASE WHEN o_custkey % 3 = 1 THEN 2 ELSE 1 END AS price FROM orders WHERE o_custkey % 3 <> 1 OR o_orderstatus = 'F'")
def replace_for_tenant(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 3).alias("tenant"), F.col("o_totalprice").alias("price"), "o_orderstatus")
    new = old.where("tenant = 1 AND o_orderstatus = 'F'").withColumn("price", F.col("price") * 2)
    return upkeep.replace_for_tenant(old.drop("o_orderstatus"), new.drop("o_orderstatus"), "tenant")


@_R.query("SELECT event_id AS id, user_id AS message, CASE WHEN user_id % 4 = 0 THEN -value ELSE value END AS value, user_id % 4 = 0 AS marked FROM events WHERE user_id % 4 <> 0 OR event_id % 2 = 0")
def replace_per_key(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that went well have new rows and a mark; keys that failed keep the old ones and stay pending."""
    old = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("message"), "value")
    done = old.select("message").distinct().where("message % 4 in (0, 1)").withColumn("ok", F.col("message") % 4 == 0)
    new = old.where("message % 4 in (0, 1) AND id % 2 = 0").withColumn("value", -F.col("value"))
    rows, marks = upkeep.replace_per_key(old, new, old.select("message").limit(0), done, "message")
    return rows.join(marks.withColumn("marked", F.lit(True)), "message", "left").select("id", "message", "value", F.coalesce("marked", F.lit(False)).alias("marked"))


@_R.query(
    """SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN c_custkey IS NULL OR (k IS NOT NULL AND c_nationkey = n) THEN n ELSE c_nationkey END AS c_nationkey, CASE WHEN c_custkey IS NULL OR (k IS NOT NULL AND c_nationkey = n) THEN coalesce(s, c_mktsegment) ELSE c_mktsegment END AS c_mktsegment
    FROM (SELECT * FROM customer WHERE c_custkey % 5 <> 0) FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE 99 END AS n, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'NEW' END AS s FROM customer WHERE c_custkey % 3 = 0) ON c_custkey = k"""
)
def upsert_if_owner(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    owner, segment = F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).otherwise(99), F.when(F.col("c_custkey") % 4 != 0, "NEW")
    new = c.where("c_custkey % 3 = 0").select("c_custkey", owner.alias("c_nationkey"), segment.alias("c_mktsegment"))
    return upkeep.conditional_upsert(c.where("c_custkey % 5 <> 0"), new, "c_custkey", "c_nationkey", ("c_mktsegment",))


@_R.query(
    """SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS nth FROM events) e WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) OR (ts < TIMESTAMP '2024-01-30' - INTERVAL 7 DAY AND nth > 3)"""
)
def artifacts_past_retention(spark: SparkSession, sf: str) -> DataFrame:
    parents = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"))
    return upkeep.past_retention(table(spark, sf, "events"), parents, "user_id", "ts", F.expr("TIMESTAMP_NTZ '2024-01-30 00:00:00'"), 7, keep=3, id="event_id").select("event_id")


@_R.query(
    """WITH p AS (SELECT p_partkey AS id, p_brand AS filename, concat('u', cast(p_partkey % 3 AS varchar(20))) AS user_id, p_name FROM part), done AS (SELECT filename, min(id) AS stub, arg_min(p_name, id) AS text FROM p WHERE id % 5 = 2 GROUP BY filename)
    SELECT id, user_id, nth = 1 AS representative, text FROM (SELECT p.*, text, row_number() OVER (PARTITION BY filename, user_id ORDER BY CASE WHEN id <> stub THEN 1 ELSE 0 END, id) AS nth FROM p JOIN done USING (filename)) WHERE nth <= 4"""
)
def crawled_fanned_out(spark: SparkSession, sf: str) -> DataFrame:
    """What was worked out for one stub of a link fills one row of every owner and at most three more."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("filename"), F.concat(F.lit("u"), F.col("p_partkey") % 3).alias("user_id"), F.col("p_name").alias("text"))
    return upkeep.fan_out(p.drop("text"), p.where("id % 5 = 2").select("id", "filename", "text"), "filename", "text", "id", "user_id", 3)


@_R.query("SELECT o_orderkey, 'u0' AS owner, (o_orderkey - 1000) // 500 AS chunk FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 5000 AND o_orderkey % 3 = 0")
def backfilled_owner(spark: SparkSession, sf: str) -> DataFrame:
    """A column filled in chunks of keys, only where it is still open."""
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, "known").alias("owner"))
    return upkeep.backfilled(o, "owner", F.lit("u0"), "o_orderkey", 500, 1000, 5000)


@_R.query("SELECT o_orderkey // 1000 AS chunk, min(o_orderkey) AS low, max(o_orderkey) AS high, count(*) AS n FROM orders GROUP BY 1")
def backfill_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return upkeep.backfill_chunks(table(spark, sf, "orders"), "o_orderkey", 1000)


@_R.query(
    """WITH b AS (SELECT vec_id // 50 AS bucket, count(*) FILTER (WHERE vec_id % 499 = 17 OR vec_id % 997 = 100) AS changed FROM embeddings GROUP BY 1)
    SELECT vec_id, label, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS total, changed = 0 AS sealed FROM embeddings JOIN b ON bucket = vec_id // 50"""
)
def index_delta(spark: SparkSession, sf: str) -> DataFrame:
    """An index brought up to the table after a few vectors changed, came and went; buckets without any are the first version's files."""
    new = table(spark, sf, "embeddings")
    k = F.col("vec_id")
    gone = new.where("vec_id = 3").withColumn("vec_id", F.lit(100_000_007).cast("long"))
    old = new.where(k % 997 != 100).withColumn("label", F.when(k % 499 == 17, -1).otherwise(F.col("label"))).union(gone)
    versions = Versions(spark, new_folder(spark, "index"))
    upkeep.refresh_index(versions, old, "vec_id", 50)
    now = upkeep.refresh_index(versions, new, "vec_id", 50, most_stale=0.05)
    sealed = [b for b in now.buckets if now.made_by(b) == 0]
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return versions.current()[1].select("vec_id", "label", total.alias("total"), F.floor(k / 50).isin(sealed).alias("sealed"))


@_R.query(
    """SELECT user_id, thread_id, count(*) AS message_count, min(date) AS date_first, max(date) AS date_last, arg_min(subject, (date, subject)) AS subject, array_to_string(list_sort(list_distinct(list(from_addr))), '|') AS participants,
      array_to_string(list_sort(list_distinct(list_filter(flatten(list(string_split(labels_csv, ','))), lambda x: x <> ''))), '|') AS all_labels FROM messages GROUP BY user_id, thread_id""",
    "messages",
)
def summaries_reconciled(spark: SparkSession, sf: str) -> DataFrame:
    """Thread summaries kept up by a stream of messages in small batches, stopped and resumed, with the base table growing under it."""
    home = new_folder(spark, "reconcile")
    own = table(spark, sf, "messages")
    versions = Versions(spark, f"{home}/summaries")
    # two batches a part, of more files the more messages there are
    files = -(-own.count() // MESSAGES_PER_FILE) or 1
    for part in (0, 1):
        own.where(F.col("history_id") % 2 == part).repartition(2 * files).write.mode("append").parquet(f"{home}/messages")
        stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", files).parquet(f"{home}/messages")
        upkeep.reconcile(stream, versions, f"{home}/checkpoint", lambda: spark.read.schema(own.schema).parquet(f"{home}/messages"), buckets=8)
    return versions.current()[1].withColumn("participants", F.array_join("participants", "|")).withColumn("all_labels", F.array_join("all_labels", "|"))


@_R.query("SELECT w, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents) GROUP BY w")
def counts_in_runs(spark: SparkSession, sf: str) -> DataFrame:
    """In how many documents each word is, counted as documents stream in: a run for each batch, added up after every fourth, a batch told twice."""
    home = new_folder(spark, "runs")
    d = table(spark, sf, "documents").select("doc_id", "text")
    # seven batches, of more files the more documents there are
    files = -(-d.count() // MESSAGES_PER_FILE) or 1
    d.repartition(7 * files, "doc_id").write.parquet(f"{home}/in")
    words = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", files).parquet(f"{home}/in").select(F.explode(F.array_distinct(search.tokens(F.col("text")))).alias("w"))
    runs = upkeep.Runs(Versions(spark, f"{home}/runs"), "w", most=4)
    runs.follow(words, f"{home}/checkpoint")
    source = next(iter(runs.versions.pointer().done))
    assert not runs.add(runs.counts(), source, 3), "a batch that is in stays in once"
    return runs.counts()


def _grown(rows: DataFrame, sizes: dict[int, int], folder: str, part: int, of: int) -> None:
    """Write each file's lines (file, line) as far as it had come after ``part`` of ``of`` writes, wherever that cuts a line; ``sizes``: whole files' bytes."""

    def run(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root)
        at, out, left = None, None, 0
        for batch in batches:
            for file, own in batch.groupby("file", sort=False):
                if file != at:
                    if out is not None:
                        out.close()
                    at, out, left = file, system.open_output_stream(f"{root}/part-{file}.jsonl"), sizes[file] * part // of
                data = "".join(f"{line}\n" for line in own["line"]).encode()[:left]
                out.write(data)
                left -= len(data)
            yield pd.DataFrame({"n": [len(batch)]})
        if out is not None:
            out.close()

    rows.mapInPandas(run, "n long").agg(F.sum("n")).collect()


def _tailed(spark: SparkSession, sf: str, name: str, files: int = 3) -> DataFrame:
    home = new_folder(spark, name)
    spark.dataSource.register(LineTail)
    lines = table(spark, sf, "conversations").select(F.pmod(F.xxhash64("conv_id"), F.lit(files)).cast("int").alias("file"), "conv_id", "turn", F.to_json(F.struct("conv_id", "turn", "text")).alias("line"))
    sizes = {r["file"]: r["bytes"] for r in lines.groupBy("file").agg(F.sum(F.octet_length("line") + 1).alias("bytes")).collect()}
    # by key and in full order, so that each write begins with the bytes of the one before
    rows = lines.repartition(files, "file").sortWithinPartitions("file", "conv_id", "turn", "line").select("file", "line")
    for part in (1, 2, 3):
        _grown(rows, sizes, f"{home}/in", part, 3)
        stream = spark.readStream.format("line_tail").option("path", f"{home}/in").option("range", 20_000).load()
        stream.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("file string, at long, line string").parquet(f"{home}/out")


@_R.query("SELECT conv_id, turn, text FROM conversations")
def json_lines_tailed(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations written as JSON lines in three writes that end inside a line, followed by a stream that stops and goes on in between."""
    return _tailed(spark, sf, "lines").select(F.from_json("line", "conv_id long, turn long, text string").alias("e")).select("e.*")


@_R.query("SELECT count(*) AS lines, count(DISTINCT conv_id) AS conversations, sum(length(text))::BIGINT AS characters FROM conversations")
def lines_carried(spark: SparkSession, sf: str) -> DataFrame:
    """No line of a followed file is lost, torn or read twice: each begins where the one before it ended."""
    own = _tailed(spark, sf, "carried").withColumn("e", F.from_json("line", "conv_id long, turn long, text string"))
    before = F.lag(F.col("at") + F.octet_length("line") + 1, 1, 0).over(W.partitionBy("file").orderBy("at"))
    fits = own.withColumn("fits", (F.col("at") == before) & F.col("e.conv_id").isNotNull())
    return fits.agg(F.count_if("fits").alias("lines"), F.countDistinct("e.conv_id").alias("conversations"), F.sum(F.length("e.text")).alias("characters"))


_MAIL = "id string, thread_id string, user_id string, date string, history_id long"


@_R.query("SELECT id, thread_id, user_id, date, row_number() OVER (ORDER BY date, id) AS history_id FROM messages", "messages")
def mail_followed(spark: SparkSession, sf: str) -> DataFrame:
    """A mailbox followed by its history in three stops; before the last one the mailbox forgot what changed since, so recent mail is swept."""
    home = new_folder(spark, "mailbox")
    order = W.orderBy("date", "id")
    m = table(spark, sf, "messages").select("id", "thread_id", "user_id", "date", F.row_number().over(order).cast("long").alias("history_id"))
    m = m.withColumn("part", F.when(F.col("date") < "2024-01-10", 0).when(F.col("date") < "2024-01-20", 1).otherwise(2)).persist()
    for part in (0, 1, 2):
        m.where(F.col("part") == part).drop("part").repartition(2).write.mode("append").parquet(f"{home}/mail")
        if part == 2:
            oldest = m.where("part < 2").agg(F.max("history_id")).first()[0] + 100
            history.forget(f"{home}/mail", oldest)
        history.follow(spark, f"{home}/mail", f"{home}/stored", f"{home}/checkpoint", _MAIL)
    m.unpersist()
    return spark.read.schema(_MAIL).parquet(f"{home}/stored")


@_R.query(
    """SELECT id, date FROM messages m LEFT JOIN (SELECT lpad(cast(doc_id AS varchar(20)), 8, '0') AS id, doc_id % 8 AS attempts, TIMESTAMP '2024-01-29 12:00:00' + to_hours(cast(doc_id % 12 AS int)) AS last FROM documents WHERE doc_id % 3 = 0) f USING (id)
    WHERE list_contains(string_split(labels_csv, ','), 'INBOX') AND id NOT IN (SELECT message_id FROM attachments) AND (f.attempts IS NULL OR (f.attempts < 6 AND (f.attempts = 0 OR epoch(TIMESTAMP '2024-01-30') - epoch(f.last) >= 2 ** f.attempts * 3600)))""",
    "messages", "attachments",
)
def summarize_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Inbox mail without a summary, newest first, those that failed only after their pause and at most six times."""
    m = table(spark, sf, "messages").where(F.array_contains("labels", "INBOX"))
    done = table(spark, sf, "attachments").select(F.col("message_id").alias("id"))
    d = F.col("doc_id")
    failed = table(spark, sf, "documents").where(d % 3 == 0).select(F.lpad(d.cast("string"), 8, "0").alias("id"), (d % 8).alias("attempts"), F.expr("TIMESTAMP_NTZ '2024-01-29 12:00:00' + make_dt_interval(0, doc_id % 12)").alias("last"))
    pending = m.join(done, "id", "left_anti").join(failed, "id", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    due = rollups.backoff_due(pending, "attempts", "last", F.expr("TIMESTAMP_NTZ '2024-01-30 00:00:00'"), 6, less=0)
    return due.select("id", "date").orderBy(F.desc("date"), "id")


@_R.query("SELECT item_id, CASE WHEN contains(text, 'hand') THEN NULL ELSE length(text) END AS length, CASE WHEN contains(text, 'hand') THEN NULL ELSE length(replace(text, 'e', '')) END AS others, CASE WHEN contains(text, 'hand') THEN NULL ELSE 1.0 END::DOUBLE AS unit, CASE WHEN contains(text, 'hand') THEN 'refused' END AS error FROM benchmark")
def embedded_by_function(spark: SparkSession, sf: str) -> DataFrame:
    """Facts through an injected embedder that fails on some items of a batch: those alone have errors, the others their own vectors."""
    plain = models.hash_embedder(8)

    def embed(texts: list[str]) -> list[list[float]]:
        if any("hand" in t for t in texts):
            raise ValueError("refused")
        return [[float(len(t)), float(len(t.replace("e", "")))] + v for t, v in zip(texts, plain(texts), strict=True)]

    b = table(spark, sf, "benchmark").select("item_id", "text")
    got = models.called(b, "text", embed, "vector", "array<double>", batch=5)
    unit = F.round(F.sqrt(F.aggregate(F.slice("vector", 3, 8), F.lit(0.0), lambda s, x: s + x * x)), 9)
    return got.select("item_id", F.get("vector", F.lit(0)).cast("long").alias("length"), F.get("vector", F.lit(1)).cast("long").alias("others"), unit.alias("unit"), "error")


@_R.query("SELECT event_type, count(*) AS n, 'count' AS reason FROM events GROUP BY event_type HAVING count(*) >= 150")
def reindex_triggered(spark: SparkSession, sf: str) -> DataFrame:
    """Types of events with enough new rows to rebuild an index, as a stream of one batch says."""
    home = new_folder(spark, "trigger")
    e = table(spark, sf, "events")
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    fired = upkeep.reindex_triggers(stream, "event_type", 150, 600_000)
    # one batch: with a timer set, the stream would wait for it after the last row
    fired.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/checkpoint").trigger(once=True).start().awaitTermination()
    return spark.read.schema("event_type string, n long, reason string").parquet(f"{home}/out")


@_R.query(
    """SELECT thread_id, user_id, n, first, last FROM (SELECT thread_id, user_id, count(*) AS n, min(date) AS first, max(date) AS last, count(*) FILTER (WHERE history_id % 10 <> 0) AS old, min(date) FILTER (WHERE history_id % 10 <> 0) AS old_first, max(date) FILTER (WHERE history_id % 10 <> 0) AS old_last
      FROM messages GROUP BY thread_id, user_id) WHERE n <> old OR first IS DISTINCT FROM old_first OR last IS DISTINCT FROM old_last""",
    "messages",
)
def summaries_changed(spark: SparkSession, sf: str) -> DataFrame:
    """What a guarded merge would write after a tenth of the messages came in late: rows that differ in any compared column."""
    sums = lambda m: m.groupBy("thread_id", "user_id").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))
    m = table(spark, sf, "messages")
    return rollups.merge_changed(sums(m.where("history_id % 10 <> 0")), sums(m), ["thread_id", "user_id"], ["n", "first", "last"])
