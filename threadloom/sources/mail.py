"""The mail model (messages, attachments, embeddings, facts, costs, events, votes) as lazy views over the driver tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The views as SQL that Spark and DuckDB both read; oracles use them as common table expressions.
VIEWS = {
    "messages": """SELECT lpad(cast(d.doc_id AS varchar(20)), 8, '0') AS id,
  lpad(cast(cast(floor(d.doc_id / 4) AS bigint) AS varchar(20)), 8, '0') AS thread_id,
  concat('u', cast(e.user_id % 3 AS varchar(20))) AS user_id,
  concat(d.source, ' <', d.source, '@example.com>') AS from_addr,
  concat('Rcpt <r', cast(e.user_id % 5 AS varchar(20)), '@example.com>') AS to_addr,
  substr(split_part(d.text, '.', 1), 1, 80) AS subject, d.text AS body_text,
  concat(replace(cast(date_trunc('second', e.ts) AS varchar(40)), ' ', 'T'), '+00:00') AS date,
  concat_ws(',', CASE WHEN e.event_type <> 'error' THEN 'INBOX' END, CASE WHEN l.quality = 1 THEN 'IMPORTANT' END,
    CASE WHEN l.toxic = 1 THEN 'CATEGORY_PROMOTIONS' END, CASE WHEN e.event_type = 'view' THEN 'UNREAD' END,
    CASE WHEN e.event_type = 'purchase' THEN 'STARRED' END, CASE WHEN e.event_type = 'signup' THEN 'SENT' END) AS labels_csv,
  e.event_id AS history_id
FROM documents d JOIN events e ON e.event_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "attachments": """SELECT p.page_id AS id, lpad(cast(p.page_id * 4 AS varchar(20)), 8, '0') AS message_id, m.user_id,
  substr(concat('URL: ', p.url), 1, 500) AS filename, 'text/html' AS mime_type, cast(length(p.html) AS bigint) AS size_bytes,
  CASE WHEN p.page_id % 3 = 0 THEN NULL ELSE p.html END AS extracted_text, p.page_id % 12 AS crawl_attempts
FROM pages p JOIN messages m ON m.id = lpad(cast(p.page_id * 4 AS varchar(20)), 8, '0')""",
    "msg_embeddings": """SELECT v.vec_id AS id, m.id AS message_id, m.user_id, 'message' AS chunk_type, v.embedding
FROM embeddings v JOIN messages m ON m.id = lpad(cast(v.vec_id AS varchar(20)), 8, '0')""",
    "propositions": """SELECT b.item_id AS id, m.user_id, m.id AS message_id, m.thread_id, b.text, v.embedding
FROM benchmark b JOIN messages m ON m.id = lpad(cast(b.item_id AS varchar(20)), 8, '0') JOIN embeddings v ON v.vec_id = b.item_id""",
    "costs": """SELECT event_id AS id, ts AS timestamp, event_type AS operation,
  concat('u', cast(user_id % 3 AS varchar(20))) AS user_id, value / 1000 AS estimated_cost_usd FROM events""",
    "agent_events": """SELECT cast(conv_id AS varchar(20)) AS session_id, turn + 1 AS seq, role AS agent_name, text AS payload FROM conversations""",
    "model_battles": """SELECT o_orderkey AS id, o_orderpriority AS variant_a, concat('clerk-', cast(o_custkey % 5 AS varchar(20))) AS variant_b,
  CASE o_orderstatus WHEN 'O' THEN 'a' WHEN 'F' THEN 'b' WHEN 'P' THEN 'tie' ELSE 'both_bad' END AS winner FROM orders""",
}
#: What views make of long texts alone: (base table, its name in the view, expression, column).  Spark makes it below the joins, so that a query for subjects or sizes moves no bodies.
_EARLY = {"messages": ("documents", "d", "substr(split_part(d.text, '.', 1), 1, 80)", "subject"), "attachments": ("pages", "p", "cast(length(p.html) AS bigint)", "size_bytes")}
_NEEDS = {"attachments": ("messages",), "msg_embeddings": ("messages",), "propositions": ("messages",)}
_BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str, **made: DataFrame) -> DataFrame:
    """A base table, or a view of the mail model with ``labels`` as an array beside its text; tables in ``made`` take the place of those it is built on."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    for need in (*_NEEDS.get(name, ()), *_BASE):
        if f" {need} " in f" {text} ".replace("\n", " ").replace(",", " "):
            frame = made[need] if need in made else table(spark, sf_dir, need)
            frame.createOrReplaceTempView(need)
    if name in _EARLY:
        base, short, expression, column = _EARLY[name]
        table(spark, sf_dir, base).selectExpr("*", f"{expression.replace(f'{short}.', '')} AS {column}").createOrReplaceTempView(f"{base}_cut")
        text = text.replace(expression, f"{short}.{column}").replace(f"FROM {base} {short}", f"FROM {base}_cut {short}")
    out = spark.sql(text)
    return out.withColumn("labels", F.filter(F.split("labels_csv", ","), lambda x: x != "")) if name == "messages" else out


def with_views(sql: str, *names: str) -> str:
    """``sql`` for DuckDB with the named views in front."""
    order: list[str] = []
    for n in names:
        order += [x for x in (*_NEEDS.get(n, ()), n) if x not in order]
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in order) + " " + sql


def given(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """What ``sql``, which Spark and DuckDB both read, makes of base tables and the named views."""
    for base in _BASE:
        if re.search(rf"\b{base}\b", with_views(sql, *names) if names else sql):
            table(spark, sf_dir, base).createOrReplaceTempView(base)
    return spark.sql(with_views(sql, *names) if names else sql)
