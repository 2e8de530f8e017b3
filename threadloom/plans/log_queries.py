"""Queries for event logs, jobs, triggers, backfills and quality measures, with the DuckDB SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import logs
from threadloom.plans.registry import Registry
from threadloom.sources.mail import table

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.oracle


def _now() -> Column:
    return F.expr("TIMESTAMP_NTZ '2024-01-30 00:00:00'")



_CALLS = "SELECT conv_id AS session_id, turn AS seq, CASE WHEN role = 'user' THEN 'call_full' ELSE 'call' END AS kind, substr(text, 1, 1) AS name, cast(turn % 3 AS varchar(20)) AS args FROM conversations"


@_R.query(
    f"""WITH e AS ({_CALLS}), r AS (SELECT *, 0 AS source FROM e WHERE kind = 'call_full'),
    s AS (SELECT session_id, seq, kind, name, args, 1 AS source FROM (SELECT *, row_number() OVER (PARTITION BY session_id, name, args ORDER BY seq) AS nth FROM e WHERE kind = 'call') c
      WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM r WHERE r.session_id = c.session_id AND r.name = c.name AND r.args = c.args))
    SELECT session_id, seq, kind, name, args, row_number() OVER (PARTITION BY session_id ORDER BY source, seq) AS place FROM (SELECT * FROM r UNION ALL SELECT * FROM s)"""
)
def calls_folded(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    kind = F.when(F.col("role") == "user", "call_full").otherwise("call")
    e = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), kind.alias("kind"), F.substring("text", 1, 1).alias("name"), (F.col("turn") % 3).cast("string").alias("args"))
    return logs.fold_calls(e).drop("source")


@_R.query(
    """SELECT conv_id, ref, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) AS nth FROM
    (SELECT conv_id, ref, turn, pos, row_number() OVER (PARTITION BY conv_id, ref ORDER BY turn, pos) AS seen FROM
      (SELECT conv_id, turn, unnest(w) AS ref, generate_subscripts(w, 1) AS pos FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]{9,}') AS w FROM conversations))) WHERE seen = 1"""
)
def refs_ordered_unique(spark: SparkSession, sf: str) -> DataFrame:
    """Long words of a conversation in order of first use, as its references are gathered."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), F.lit(0)).alias("refs"))
    return logs.ordered_unique(c, "conv_id", "refs", "turn")


@_R.query("SELECT session_id, seq FROM agent_events WHERE seq > 3 ORDER BY seq, session_id LIMIT 100", "agent_events")
def events_tail(spark: SparkSession, sf: str) -> DataFrame:
    """A reader's next events over all sessions; ties go by session."""
    e = table(spark, sf, "agent_events").select("session_id", "seq")
    return logs.page(e.where("seq > 3"), F.col("seq"), F.col("session_id"), limit=100, offset=0)


@_R.query(
    """SELECT user_id, pending, round(coalesce(n, 0) / 86400, 3) AS rate, CASE WHEN round(coalesce(n, 0) / 86400, 3) > 0 THEN floor(pending / round(coalesce(n, 0) / 86400, 3))::BIGINT END AS eta_seconds
    FROM (SELECT user_id % 3 AS user_id, count(*) AS pending FROM events WHERE event_type = 'view' GROUP BY 1)
    LEFT JOIN (SELECT user_id % 3 AS user_id, count(*) * 400 AS n FROM events WHERE event_type <> 'view' AND ts > TIMESTAMP '2024-01-29' GROUP BY 1) USING (user_id)"""
)
def summary_rate(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select((F.col("user_id") % 3).alias("user_id"), "event_type", "ts")
    done = e.where("event_type <> 'view'").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(400))))
    return logs.rate_and_eta(done, e.where("event_type = 'view'"), "user_id", "ts", _now(), 86400)


_JOBS = """SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'done' ELSE 'error' END AS status, 'x' AS detail,
  o_orderkey % 90 AS completed, o_custkey % 100 AS total, o_orderkey % 7 AS start_completed, {start} AS started_at, {update} AS updated_at FROM orders"""
_DUCK_JOBS = _JOBS.format(start="TIMESTAMP '2024-01-29 23:00:00' + to_seconds(o_orderkey % 3600)", update="TIMESTAMP '2024-01-29 23:45:00' + to_seconds(o_custkey * 7 % 900)")
_SPARK_JOBS = _JOBS.format(start="TIMESTAMP_NTZ '2024-01-29 23:00:00' + make_dt_interval(0, 0, 0, o_orderkey % 3600)", update="TIMESTAMP_NTZ '2024-01-29 23:45:00' + make_dt_interval(0, 0, 0, o_custkey * 7 % 900)")


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_SPARK_JOBS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf, "orders"))


@_R.query(
    f"""SELECT job_id, round(r, 3) AS rate_per_sec, round(greatest(total - completed, 0) / r) AS eta_seconds FROM (SELECT *, CASE WHEN status = 'running' AND total > 0 AND completed > start_completed
      AND epoch(TIMESTAMP '2024-01-30') - epoch(started_at) >= 5 THEN (completed - start_completed) / (epoch(TIMESTAMP '2024-01-30') - epoch(started_at)) END AS r FROM ({_DUCK_JOBS}))"""
)
def job_rates(spark: SparkSession, sf: str) -> DataFrame:
    return logs.job_progress(_jobs(spark, sf), _now()).select("job_id", "rate_per_sec", "eta_seconds")


@_R.query(f"SELECT job_id, CASE WHEN s THEN 'stopped' ELSE status END AS status, CASE WHEN s THEN 'stale — process gone' ELSE detail END AS detail FROM (SELECT *, status = 'running' AND epoch(TIMESTAMP '2024-01-30') - epoch(updated_at) > 600 AS s FROM ({_DUCK_JOBS}))")
def jobs_reaped(spark: SparkSession, sf: str) -> DataFrame:
    return logs.reaped(_jobs(spark, sf), _now()).select("job_id", "status", "detail")


@_R.query(f"SELECT job_id FROM ({_DUCK_JOBS}) WHERE status = 'running' AND epoch(TIMESTAMP '2024-01-30') - epoch(updated_at) <= 90")
def jobs_alive(spark: SparkSession, sf: str) -> DataFrame:
    return logs.alive(_jobs(spark, sf), _now()).select("job_id")


@_R.query(
    """SELECT user_id, count(*) FILTER (WHERE id > top * k / 4) AS new, max(id) AS top, count(*) FILTER (WHERE id > top * k / 4) > 0 AND (count(*) FILTER (WHERE id > top * k / 4) >= 100 OR k = 3) AS rebuild
    FROM (SELECT user_id, id, CAST(right(user_id, 1) AS INT) + 1 AS k, (SELECT max(event_id) FROM events) AS top FROM costs) GROUP BY user_id, k""",
    "costs",
)
def reindex_needed(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "costs").select("user_id", "id")
    k = F.substring("user_id", 2, 1).cast("int") + 1
    state = c.groupBy("user_id").agg(F.lit(1)).select("user_id").join(F.broadcast(table(spark, sf, "events").agg(F.max("event_id").alias("top"))))
    at = F.when(k == 3, F.expr("TIMESTAMP_NTZ '2024-01-29 00:00:00'")).otherwise(F.expr("TIMESTAMP_NTZ '2024-01-29 23:59:00'"))
    state = state.select("user_id", (F.col("top") * k / 4).alias("indexed_max"), at.alias("indexed_at"))
    return logs.needs_reindex(c, state, "user_id", "id", _now(), least_new=100)


@_R.query(
    """SELECT lang, count(*) FILTER (WHERE NOT f AND NOT a) AS done, count(*) FILTER (WHERE NOT f AND a) AS auto, count(*) FILTER (WHERE f) AS failed, count(*) FILTER (WHERE f AND e) AS exception,
      count(*) FILTER (WHERE f AND NOT e AND m) AS missing_from_output, count(*) FILTER (WHERE f AND NOT e AND NOT m) AS empty_output
    FROM (SELECT lang, doc_id % 11 = 0 AS e, doc_id % 7 = 0 AS m, doc_id % 5 = 0 AS a, doc_id % 11 = 0 OR doc_id % 7 = 0 OR doc_id % 13 = 0 AS f FROM documents) GROUP BY lang"""
)
def backfill_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    d, i = table(spark, sf, "documents"), F.col("doc_id")
    output = F.when(i % 7 == 0, None).when(i % 13 == 0, " ").otherwise("ok")
    return logs.outcomes(d.select("lang", output.alias("output"), F.when(i % 11 == 0, "boom").alias("error"), (i % 5 == 0).alias("automatic")), "lang")


@_R.query("SELECT thread_id, max(date) AS last, max(date) > '2024-01-29T00:00:00+00:00' AS fresh FROM messages GROUP BY thread_id", "messages")
def threads_fresh_first(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "messages").select("thread_id", F.substring("date", 1, 19).cast("timestamp_ntz").alias("at"))
    last = F.concat(F.date_format("last", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return logs.fresh_first(m, ["thread_id"], "at", _now()).select("thread_id", last.alias("last"), "fresh")


@_R.query("SELECT id, date FROM messages ORDER BY date DESC, id LIMIT 25 OFFSET 50", "messages")
def messages_third_page(spark: SparkSession, sf: str) -> DataFrame:
    return logs.page(table(spark, sf, "messages").select("id", "date"), F.desc("date"), F.col("id"), limit=25, offset=50)


_GRADED = "SELECT o_custkey % 40 AS query, o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 3 ELSE o_orderkey % 3 END AS grade, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders"


@_R.query(
    f"""WITH g AS ({_GRADED}), i AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, id) AS nth FROM g)
    SELECT query, round(sum(CASE WHEN rank <= 10 THEN (2 ** grade - 1) / log2(rank + 1) END) / sum(CASE WHEN nth <= 10 THEN (2 ** grade - 1) / log2(nth + 1) END), 6) AS ndcg,
      round(count(*) FILTER (WHERE rank <= 10 AND grade >= 2) / 10, 6) AS precision, round(count(*) FILTER (WHERE rank <= 10 AND grade >= 2) / count(*) FILTER (WHERE grade >= 2), 6) AS recall,
      round(count(*) FILTER (WHERE rank <= 10 AND grade >= 3) / count(*) FILTER (WHERE grade >= 3), 6) AS high_capture FROM i GROUP BY query"""
)
def ranking_quality(spark: SparkSession, sf: str) -> DataFrame:
    g = spark.sql(_GRADED.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf, "orders"))
    return logs.ranking_quality(g.select("query", "id", "rank"), g.select("query", "id", "grade"))


@_R.query("SELECT count(*) FILTER (WHERE l_quantity > l_tax * 600) AS wins, count(*) FILTER (WHERE l_quantity < l_tax * 600) AS losses, count(*) FILTER (WHERE l_quantity = l_tax * 600) AS ties FROM lineitem")
def ranking_wins(spark: SparkSession, sf: str) -> DataFrame:
    return logs.wins(table(spark, sf, "lineitem").select("l_quantity", (F.col("l_tax") * 600).alias("other")), "l_quantity", "other")


_NUM, _DAY, _NAME = r"\b\d[\d,.$]*", r"(?i)\b(?:\d{1,2}/\d{1,2}(?:/\d{2,4})?|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\w*\s+\d{1,2}|\d{4}-\d{2}-\d{2})", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+"
_TRI = "list_distinct(list_transform(range(1, greatest(len({w}) - 1, 1)), lambda i: {w}[i] || ' ' || {w}[i + 1] || ' ' || {w}[i + 2]))"


@_R.query(
    f"""WITH d AS (SELECT lang AS run, text AS body, substr(text, 20, 160) AS summary, doc_id % 9 = 0 AS bad, doc_id % 500 AS ms FROM documents),
    w AS (SELECT *, regexp_extract_all(lower(body), '[a-z][a-z'']+') AS bw, regexp_extract_all(lower(summary), '[a-z][a-z'']+') AS sw FROM d),
    t AS (SELECT *, {_TRI.format(w='bw')} AS bt, {_TRI.format(w='sw')} AS st, NOT bad AND summary <> '' AS fine FROM w),
    x AS (SELECT run, fine, ms, length(summary) AS n, len(regexp_extract_all(summary, '{_NUM}')) + 2 * len(regexp_extract_all(summary, '{_DAY}')) + len(regexp_extract_all(summary, '{_NAME}')) AS spec,
      CASE WHEN len(st) > 0 THEN len(list_intersect(bt, st)) / len(st) ELSE 0 END AS cov FROM t),
    a AS (SELECT run, count(*) FILTER (WHERE fine) AS ok, count(*) FILTER (WHERE NOT fine) AS failed, floor(quantile_cont(n, 0.5) FILTER (WHERE fine))::BIGINT AS med_len, (sum(spec) FILTER (WHERE fine))::BIGINT AS spec_total,
      round(avg(cov) FILTER (WHERE fine), 3) AS cov_avg, floor(quantile_cont(ms, 0.5) FILTER (WHERE fine))::BIGINT AS med_ms FROM x GROUP BY run)
    SELECT *, round(spec_total + 500 * cov_avg - 20 * failed, 6) AS score FROM a"""
)
def summary_quality(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    error = F.when(F.col("doc_id") % 9 == 0, "late")
    return logs.summary_quality(d.select(F.col("lang").alias("run"), F.col("text").alias("body"), F.substring("text", 20, 160).alias("summary"), error.alias("error"), (F.col("doc_id") % 500).alias("ms")))


@_R.query("SELECT (SELECT count(*) FROM part) > 3 AND max(x) - min(x) < 0.05 AS rerank FROM (SELECT p_retailprice / 2000 AS x FROM part ORDER BY x DESC LIMIT 5)")
def rerank_needed(spark: SparkSession, sf: str) -> DataFrame:
    return logs.needs_rerank(table(spark, sf, "part").select((F.col("p_retailprice") / 2000).alias("score")))
