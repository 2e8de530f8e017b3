"""Queries over the mail model and the DuckDB SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.functions import urls
from threadloom.operators import rollups, search
from threadloom.sources.mail import table, with_views
from threadloom.sources.word_index import WordIndex, index_of

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
USER, AS_OF = "u1", "2024-01-31T00:00:00Z"
QUERY_VECTOR = [round(((i * 37) % 17 - 8) / 40.0, 4) for i in range(64)]
TERMS = ["the", "of", "tion", "and"]
_DOT = "list_sum(list_transform(list_zip({v}, [" + ",".join(map(str, QUERY_VECTOR)) + "]::DOUBLE[]), lambda x: x[1]::DOUBLE * x[2]))"


def query(sql: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


_HAS = "list_contains(string_split(labels_csv, ','), '{}')".format


@query(
    f"""SELECT thread_id, id, subject, from_addr, date, message_count FROM (
      SELECT *, count(*) OVER (PARTITION BY thread_id) AS message_count, row_number() OVER (PARTITION BY thread_id ORDER BY date DESC, id DESC) AS nth
      FROM messages WHERE user_id = '{USER}' AND thread_id IN (SELECT thread_id FROM messages WHERE user_id = '{USER}' AND {_HAS('INBOX')}))
    WHERE nth = 1 ORDER BY date DESC, thread_id DESC LIMIT 50""",
    "messages",
)
def inbox(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.inbox(table(spark, sf, "messages"), USER)


def _priority(section: str, where: str) -> None:
    sql = f"""SELECT thread_id, date_last FROM (SELECT thread_id, max(date) AS date_last,
      bool_or({_HAS('IMPORTANT')} AND {_HAS('UNREAD')} AND {_HAS('INBOX')}) AS iu, bool_or({_HAS('STARRED')}) AS st, bool_or({_HAS('INBOX')}) AS ib
      FROM messages WHERE user_id = '{USER}' GROUP BY thread_id) WHERE {where}"""
    name = f"priority_{section}"
    QUERIES[name] = lambda spark, sf: rollups.priority_section(table(spark, sf, "messages"), USER, section)
    ORACLE_SQL[name] = with_views(sql, "messages")


_priority("important_unread", "iu")
_priority("starred", "st AND NOT iu")
_priority("everything_else", "ib AND NOT iu AND NOT st")


_LABELS = "array_to_string(list_sort(list_distinct(list_filter(flatten(list(string_split(labels_csv, ','))), lambda x: x <> ''))), '|') AS all_labels"
_SUMMARY = f"""count(*) AS message_count, min(date) AS date_first, max(date) AS date_last, arg_min(subject, (date, subject)) AS subject, array_to_string(list_sort(list_distinct(list(from_addr))), '|') AS participants, {_LABELS}"""


def _flat(summaries: DataFrame) -> DataFrame:
    return summaries.select(*(F.array_join(c, "|").alias(c) if t == "array<string>" else F.col(c) for c, t in summaries.dtypes))


@query(
    f"""SELECT user_id, thread_id, count(*) AS message_count, min(date) AS date_first, max(date) AS date_last, arg_min(subject, (date, id)) AS subject, array_to_string(list(from_addr ORDER BY date, id), '|') AS all_from_addrs,
      array_to_string(list_filter(list(from_addr ORDER BY date, id), lambda x, i: list_position(list(from_addr ORDER BY date, id), x) = i), '|') AS participants, {_LABELS}
    FROM messages GROUP BY user_id, thread_id""",
    "messages",
)
def thread_summary_full(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(rollups.thread_summary(table(spark, sf, "messages")))


@query(f"SELECT user_id, thread_id, {_SUMMARY} FROM messages m WHERE (user_id, thread_id) IN (SELECT (user_id, thread_id) FROM messages WHERE history_id % 7 = 3) GROUP BY user_id, thread_id", "messages")
def thread_summary_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The threads that a seventh of the messages touch, from all their messages."""
    m = table(spark, sf, "messages")
    return _flat(rollups.thread_summary_incremental(m, m.where("history_id % 7 = 3")))


@query(f""", old AS (SELECT user_id, thread_id, {_SUMMARY} FROM messages WHERE history_id % 10 <> 0 GROUP BY user_id, thread_id), new AS (SELECT user_id, thread_id, {_SUMMARY} FROM messages GROUP BY user_id, thread_id) SELECT * FROM new EXCEPT SELECT * FROM old""", "messages")
def thread_summary_noop_guard(spark: SparkSession, sf: str) -> DataFrame:
    """The summaries a guarded merge writes after a tenth of the messages came in late: those that differ in any column."""
    m = table(spark, sf, "messages")
    every = m.select("user_id", "thread_id").distinct()
    old, new = (rollups.thread_summary_incremental(x, every) for x in (m.where("history_id % 10 <> 0"), m))
    return _flat(rollups.merge_changed(old, new, ["user_id", "thread_id"], rollups.SUMMARY_COLUMNS))


@query(
    """SELECT user_id, lower(trim(split_part(split_part(from_addr, '<', 2), '>', 1))) AS email, min(n) AS message_count,
      round(ln(min(n) + 1) / ln(max(top) + 1), 6) AS score
    FROM (SELECT *, max(n) OVER (PARTITION BY user_id) AS top FROM (SELECT user_id, from_addr, count(*) AS n FROM messages GROUP BY 1, 2)) GROUP BY 1, 2""",
    "messages",
)
def contact_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.contact_frequency(table(spark, sf, "messages"))


@query("SELECT from_addr, count(*) AS n FROM messages GROUP BY 1 ORDER BY n DESC, from_addr LIMIT 1", "messages")
def owner_email(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "messages").groupBy("from_addr").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "from_addr").limit(1)


@query(
    """SELECT thread_id, max(date) AS date_last FROM messages WHERE from_addr LIKE '%src%' AND subject ILIKE '%en%' AND date >= '2024-01-01' AND date <= '2024-01-25T23:59:59+00:00'
    AND id IN (SELECT message_id FROM attachments) GROUP BY thread_id ORDER BY date_last DESC, thread_id LIMIT 100""",
    "messages",
    "attachments",
)
def metadata_query(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "messages")
    a = table(spark, sf, "attachments").select(F.col("message_id").alias("id"))
    own = m.where(m.from_addr.contains("src") & m.subject.ilike("%en%") & (m.date >= "2024-01-01") & (m.date <= "2024-01-25T23:59:59+00:00"))
    return own.join(a, "id", "left_semi").groupBy("thread_id").agg(F.max("date").alias("date_last")).orderBy(F.desc("date_last"), "thread_id").limit(100)


@query("SELECT id, thread_id FROM messages m WHERE NOT EXISTS (SELECT 1 FROM msg_embeddings e WHERE e.message_id = m.id)", "messages", "msg_embeddings")
def messages_without_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "msg_embeddings").select(F.col("message_id").alias("id"))
    return table(spark, sf, "messages").join(e, "id", "left_anti").select("id", "thread_id")


@query("SELECT operation, count(*) AS n, round(sum(estimated_cost_usd), 6) AS usd FROM costs GROUP BY operation", "costs")
def cost_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "costs").groupBy("operation").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("estimated_cost_usd"), 6).alias("usd"))


@query("SELECT user_id, round(sum(estimated_cost_usd), 6) AS usd, round(1000 - sum(estimated_cost_usd), 6) AS remaining FROM costs GROUP BY user_id", "costs")
def cost_total_by_user(spark: SparkSession, sf: str) -> DataFrame:
    total = F.sum("estimated_cost_usd")
    return table(spark, sf, "costs").groupBy("user_id").agg(F.round(total, 6).alias("usd"), F.round(1000 - total, 6).alias("remaining"))


@query(
    """SELECT user_id, id, round(spent, 6) AS spent FROM (SELECT user_id, id, sum(estimated_cost_usd) OVER (PARTITION BY user_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS spent FROM costs) WHERE spent <= 5""",
    "costs",
)
def cost_running_budget(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.running_budget(table(spark, sf, "costs"), 5.0).select("user_id", "id", F.round("spent", 6).alias("spent"))


@query(
    """SELECT user_id, count(*) FILTER (WHERE extracted_text IS NULL AND crawl_attempts = 0) AS fast, count(*) FILTER (WHERE extracted_text IS NULL AND crawl_attempts BETWEEN 1 AND 9) AS slow,
      count(*) FILTER (WHERE extracted_text IS NULL AND crawl_attempts >= 10) AS dead, count(*) FILTER (WHERE extracted_text IS NOT NULL) AS done FROM attachments GROUP BY user_id""",
    "messages",
    "attachments",
)
def crawl_lanes(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.crawl_lanes(table(spark, sf, "attachments"))


@query(
    """SELECT id, crawl_attempts FROM attachments JOIN (SELECT id AS message_id, date FROM messages) USING (message_id) WHERE extracted_text IS NULL AND crawl_attempts < 10 AND (crawl_attempts = 0
      OR epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(CAST(substr(date, 1, 19) AS TIMESTAMP)) >= pow(2, crawl_attempts - 1) * 3600)""",
    "messages",
    "attachments",
)
def crawl_pending_backoff(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "messages").select(F.col("id").alias("message_id"), F.to_timestamp("date").alias("tried"))
    queue = table(spark, sf, "attachments").where("extracted_text IS NULL").join(m, "message_id")
    return rollups.backoff_due(queue, "crawl_attempts", "tried", F.lit(AS_OF).cast("timestamp"), 10).select("id", "crawl_attempts")


@query(
    """SELECT variant, count(*) FILTER (WHERE winner = side) AS wins, count(*) FILTER (WHERE winner IN ('a', 'b') AND winner <> side) AS losses, count(*) FILTER (WHERE winner = 'tie') AS ties,
      count(*) FILTER (WHERE winner = 'both_bad') AS both_bad, count(*) AS total, round(count(*) FILTER (WHERE winner = side) / count(*), 6) AS win_rate
    FROM (SELECT winner, 'a' AS side, variant_a AS variant FROM model_battles UNION ALL SELECT winner, 'b', variant_b FROM model_battles) GROUP BY variant""",
    "model_battles",
)
def battle_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.battle_leaderboard(table(spark, sf, "model_battles"))


@query("SELECT session_id, max(seq) + 1 AS next_seq, count(*) AS n, arg_max(agent_name, seq) AS last_agent FROM agent_events GROUP BY session_id", "agent_events")
def agent_events_next_seq(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "agent_events").groupBy("session_id").agg((F.max("seq") + 1).alias("next_seq"), F.count(F.lit(1)).alias("n"), F.max_by("agent_name", "seq").alias("last_agent"))


@query("SELECT session_id, seq, agent_name FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS nth FROM agent_events WHERE agent_name = 'assistant') WHERE nth = 1", "agent_events")
def agent_latest_final(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.latest_per(table(spark, sf, "agent_events").where("agent_name = 'assistant'"), ["session_id"], F.desc("seq")).select("session_id", "seq", "agent_name")


@query("SELECT user_id, count(*) AS messages, count(e.message_id) AS embedded, round(100.0 * count(e.message_id) / count(*), 1) AS pct FROM messages m LEFT JOIN (SELECT DISTINCT message_id FROM msg_embeddings) e ON e.message_id = m.id GROUP BY user_id", "messages", "msg_embeddings")
def embed_coverage(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "msg_embeddings").select("message_id").distinct()
    j = table(spark, sf, "messages").join(e, F.col("id") == F.col("message_id"), "left")
    return j.groupBy("user_id").agg(F.count(F.lit(1)).alias("messages"), F.count("message_id").alias("embedded"), F.round(100.0 * F.count("message_id") / F.count(F.lit(1)), 1).alias("pct"))


@query(f"SELECT id, round({_DOT.format(v='embedding')}, 6) AS score FROM msg_embeddings ORDER BY score DESC, id LIMIT 20", "messages", "msg_embeddings")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.vector_topk(table(spark, sf, "msg_embeddings"), QUERY_VECTOR, 20)


@query(
    f"""SELECT id, round({_DOT.format(v='embedding')}, 6) AS score FROM (SELECT id, embedding FROM msg_embeddings ORDER BY
      list_sum(list_transform(list_zip(embedding[1:16], [{','.join(map(str, QUERY_VECTOR[:16]))}]::DOUBLE[]), lambda x: x[1]::DOUBLE * x[2])) DESC, id LIMIT 100) ORDER BY score DESC, id LIMIT 20""",
    "messages",
    "msg_embeddings",
)
def vector_funnel_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.funnel_topk(table(spark, sf, "msg_embeddings"), QUERY_VECTOR, 20, 100, 16)


@query(
    f"SELECT e.id, round({_DOT.format(v='e.embedding')}, 6) AS score FROM msg_embeddings e WHERE e.message_id IN (SELECT id FROM messages WHERE from_addr ILIKE '%SRC1%' AND user_id = '{USER}') ORDER BY score DESC, id LIMIT 10",
    "messages",
    "msg_embeddings",
)
def vector_restricted(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "messages").where((F.col("user_id") == USER) & F.col("from_addr").ilike("%SRC1%")).select(F.col("id").alias("message_id"))
    return search.vector_topk(table(spark, sf, "msg_embeddings").join(m, "message_id", "left_semi"), QUERY_VECTOR, 10)


def bm25_sql(terms: list[str]) -> str:
    """SQL for BM25 of ``terms`` over ``toks`` (id, words)."""
    return f"""SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM (
    SELECT t.*, count(*) OVER (PARTITION BY term) AS df, w.n, w.avgdl FROM (
      SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(words) AS dl, unnest(list_filter(words, lambda x: list_contains({terms}, x))) AS term FROM toks) GROUP BY id, dl, term) t,
      (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM toks) w) GROUP BY id"""


_BM25 = bm25_sql(TERMS)
_TOKS = "toks AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS words FROM documents)"


def _documents(spark: SparkSession, sf: str) -> WordIndex:
    return index_of(spark, "documents", table(spark, sf, "documents"), "doc_id", ["text"])


@query(f"WITH {_TOKS} {_BM25}")
def bm25_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).bm25(TERMS)


@query(f"WITH {_TOKS}, s AS ({_BM25}) SELECT id, round(CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1.0 END, 6) AS score FROM s")
def bm25_normalized(spark: SparkSession, sf: str) -> DataFrame:
    scored = _documents(spark, sf).bm25(TERMS)
    return search.min_max(scored, "score", 1.0).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {_TOKS}, s AS ({_BM25}), b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s ORDER BY rank LIMIT 200),
    v AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT vec_id AS id, round({_DOT.format(v='embedding')}, 6) AS score FROM embeddings) ORDER BY rank LIMIT 200)
    SELECT coalesce(b.id, v.id) AS id, round(coalesce(1 / (60 + b.rank), 0) + coalesce(1 / (60 + v.rank), 0), 9) AS rrf FROM b FULL JOIN v ON b.id = v.id"""
)
def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    def ranked(df: DataFrame) -> DataFrame:
        return df.orderBy(F.desc("score"), "id").limit(200).withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")))

    b = ranked(_documents(spark, sf).bm25(TERMS))
    v = ranked(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.round(search.dot(F.col("embedding"), QUERY_VECTOR), 6).alias("score")))
    return search.fuse(b, v)


@query("SELECT id, round(exp(-0.693 * greatest((epoch(TIMESTAMP '2024-01-31') - epoch(CAST(substr(date, 1, 19) AS TIMESTAMP))) / 86400, 0) / 60), 6) AS recency FROM messages", "messages")
def recency_score(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "messages").select("id", F.round(search.recency(F.col("date"), AS_OF), 6).alias("recency"))


@query(
    "SELECT id, round(greatest(0.0, least(1.0, " + " + ".join(f"CASE WHEN {_HAS(k)} THEN {v} ELSE 0 END" for k, v in search.LABEL_SCORES.items()) + ")), 6)::DOUBLE AS label_score FROM messages",
    "messages",
)
def label_score(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "messages").select("id", F.round(search.label_score(F.col("labels")), 6).alias("label_score"))


@query("SELECT id, regexp_replace(regexp_replace(trim(lower(subject)), '^(re|fwd|fw):\\s*', ''), '[0-9]+', '#', 'g') AS subject FROM messages", "messages")
def normalize_subject(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "messages").select("id", search.normalized_subject(F.col("subject")).alias("subject"))


@query("SELECT word, n FROM (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM documents) WHERE length(word) <= 24 GROUP BY word) WHERE n >= 20")
def spell_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "documents").select(F.explode(search.tokens(F.col("text"))).alias("word")).where(F.length("word") <= 24)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")


@query(
    """WITH t AS (SELECT DISTINCT doc_id, regexp_matches(tok, '^[A-Z]{2,5}$') AS caps, lower(tok) AS term FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS tok FROM documents))
    SELECT term, count(*) FILTER (WHERE caps) AS caps_df, count(*) FILTER (WHERE NOT caps) AS other_df FROM t GROUP BY term HAVING count(*) FILTER (WHERE caps) > 0"""
)
def caps_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Words in capitals are found first; only for those are texts with another spelling counted."""
    whole = lambda p: F.lit(rf"(?<![\p{{L}}\p{{N}}_]){p}(?![\p{{L}}\p{{N}}_])")
    found = lambda p: F.array_distinct(F.regexp_extract_all("text", whole(p), F.lit(0)))
    d = table(spark, sf, "documents").select("text")
    raised = d.select(F.explode(found("[A-Z]{2,5}")).alias("w")).groupBy(F.lower("w").alias("term")).agg(F.count(F.lit(1)).alias("caps_df"))
    others = F.array_distinct(F.transform(F.filter(found(r"\p{L}{2,5}"), lambda w: ~w.rlike("^[A-Z]+$")), F.lower))
    seen = d.select(F.explode(others).alias("term")).join(raised.select("term"), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("other_df"))
    return raised.join(seen, "term", "left").select("term", "caps_df", F.coalesce("other_df", F.lit(0)).alias("other_df"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, (regexp_matches(regexp_extract(url, '^https?://([^/:?#]+)', 1), '(^|\\.)example\\.net$') OR url LIKE '%://e.%' OR url LIKE '%://r.%') AS denied FROM pages")
def url_denylist(spark: SparkSession, sf: str) -> DataFrame:
    """Links not to be crawled, with a domain blocked beyond the fixed lists."""
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", urls.host_of(url).alias("host"), urls.crawl_denied(url, ("example.net",)).alias("denied"))


@query("SELECT page_id, CASE WHEN contains(url, '?utm_source=feed') THEN replace(url, '?utm_source=feed', '') ELSE url END AS url FROM pages")
def url_strip_tracking(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", urls.without_trackers(F.col("url")).alias("url"))


@query("SELECT doc_id, md5(CASE WHEN length(text) > 15000 THEN left(text, 11000) || chr(10) || chr(10) || '[...]' || chr(10) || chr(10) || right(text, 4000) ELSE text END) AS body, floor(length(text) / 4)::BIGINT AS tokens FROM documents")
def truncate_body(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.truncated(F.col("text"))).alias("body"), tx.estimated_tokens(F.col("text")).cast("long").alias("tokens"))


@query("SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: regexp_matches(w, '[0-9]')))), ' ') AS value_tokens FROM benchmark")
def value_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.array_join(tx.value_tokens(F.col("text")), " ").alias("value_tokens"))


@query("SELECT id, history_id // 100 AS bucket, count(*) OVER (PARTITION BY history_id // 100) AS size FROM messages", "messages")
def delta_buckets(spark: SparkSession, sf: str) -> DataFrame:
    bucket = F.expr("history_id DIV 100")
    return table(spark, sf, "messages").select("id", bucket.alias("bucket"), F.count(F.lit(1)).over(W.partitionBy(bucket)).alias("size"))


@query("WITH c AS (SELECT greatest(1, ceil(count(*) / 300.0))::BIGINT AS k FROM documents) SELECT doc_id FROM documents, c WHERE (doc_id * 2654435761 % 4294967296) // 65536 % k = 0")
def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    """About 300 documents, the same ones each time: one in so many by a hash of the id."""
    return search.hash_sample(table(spark, sf, "documents").select("doc_id"), "doc_id", 300)


@query("SELECT user_id, count(*) AS n, sum(length(payload))::BIGINT AS bytes FROM (SELECT agent_name AS user_id, payload FROM agent_events) GROUP BY user_id", "agent_events")
def retention_report(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "agent_events").withColumnRenamed("agent_name", "user_id")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("payload")).alias("bytes"))


@query(
    """WITH g AS (SELECT e.user_id % 20 AS q, row_number() OVER (PARTITION BY e.user_id % 20 ORDER BY e.value DESC, e.event_id) AS rank, e.event_id % 4 AS grade FROM events e)
    SELECT q, round(sum((pow(2, grade) - 1) / log2(rank + 1)), 6) AS dcg, round(sum(CASE WHEN grade >= 2 THEN 1 ELSE 0 END) / 10.0, 6)::DOUBLE AS precision_at_10 FROM g WHERE rank <= 10 GROUP BY q"""
)
def eval_ranking(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select((F.col("user_id") % 20).alias("q"), "value", "event_id", (F.col("event_id") % 4).alias("grade"))
    ranked = e.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("value"), "event_id"))).where("rank <= 10")
    return ranked.groupBy("q").agg(F.round(F.sum((F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("rank") + 1)), 6).alias("dcg"), F.round(F.count_if(F.col("grade") >= 2) / 10.0, 6).alias("precision_at_10"))
