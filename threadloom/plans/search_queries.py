"""Queries for candidate filters, text search over several fields, facts and guests' SQL, with the DuckDB SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import cleaning
from threadloom.operators import facts, filters, gate, search
from threadloom.plans.mail_queries import _DOT, _HAS, QUERY_VECTOR, USER
from threadloom.plans.registry import Registry
from threadloom.sources.mail import table
from threadloom.sources.word_index import index_of

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.oracle
PAIR = ["the", "of"]


@_R.query(
    f"SELECT id FROM messages m WHERE user_id = '{USER}' AND contains(lower(from_addr), 'src1') AND date >= '2024-01-02' AND date <= '2024-01-28T23:59:59+00:00' AND {_HAS('INBOX')} AND NOT EXISTS (SELECT 1 FROM attachments a WHERE a.message_id = m.id)",
    "messages", "attachments",
)
def candidates_structured(spark: SparkSession, sf: str) -> DataFrame:
    found = filters.candidates(table(spark, sf, "messages"), table(spark, sf, "attachments"), user=USER, sender="SRC1", after="2024-01-02", before="2024-01-28", has_attachment=False, labels=("INBOX",))
    return found.select("id")


@_R.query("SELECT id FROM messages m WHERE contains(lower(subject), 'e') AND EXISTS (SELECT 1 FROM attachments a WHERE a.message_id = m.id)", "messages", "attachments")
def candidates_with_attachment(spark: SparkSession, sf: str) -> DataFrame:
    return filters.candidates(table(spark, sf, "messages"), table(spark, sf, "attachments"), subject="E", has_attachment=True).select("id")


@_R.query("SELECT thread_id, max(date) AS date_last FROM messages WHERE contains(lower(from_addr), 'src3') AND contains(lower(subject), 'e') AND date >= '2024-01-01' GROUP BY thread_id ORDER BY date_last DESC, thread_id LIMIT 100", "messages")
def metadata_threads(spark: SparkSession, sf: str) -> DataFrame:
    found = filters.candidates(table(spark, sf, "messages"), table(spark, sf, "attachments"), sender="src3", subject="e", after="2024-01-01")
    return found.groupBy("thread_id").agg(F.max("date").alias("date_last")).orderBy(F.desc("date_last"), "thread_id").limit(100)


@_R.query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def not_in_orders(spark: SparkSession, sf: str) -> DataFrame:
    big = table(spark, sf, "orders").where("o_totalprice > 250000").select("o_custkey")
    return filters.not_in(table(spark, sf, "customer").select("c_custkey"), "c_custkey", big, "o_custkey")


@_R.query(
    """SELECT 'null' AS side, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_custkey > 5 THEN o_custkey END FROM orders)
    UNION ALL SELECT 'none', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE false) UNION ALL SELECT 'some', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey > 5)"""
)
def not_in_null(spark: SparkSession, sf: str) -> DataFrame:
    """How many customers pass where the other side holds a null (none do), nothing, or some keys."""
    own, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders")
    sides = {"null": o.select(F.when(F.col("o_custkey") > 5, F.col("o_custkey")).alias("k")), "none": o.where("false").select(F.col("o_custkey").alias("k")), "some": o.where("o_custkey > 5").select(F.col("o_custkey").alias("k"))}
    counts = [filters.not_in(own, "c_custkey", other, "k").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("side"), "n") for name, other in sides.items()]
    return counts[0].union(counts[1]).union(counts[2])


@_R.query("SELECT id FROM messages WHERE history_id % 4 = 0 OR " + " OR ".join(_HAS(x) for x in ("CATEGORY_PROMOTIONS", "CATEGORY_UPDATES", "CATEGORY_SOCIAL", "CATEGORY_FORUMS")), "messages")
def bulk_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Bulk mail by its labels, or by a header that tells how to unsubscribe."""
    header = lambda name: F.struct(F.lit(name).alias("name"), F.lit("<mailto:x>").alias("value"))
    headers = F.when(F.col("history_id") % 4 == 0, F.array(header("From"), header("LIST-Unsubscribe"))).when(F.col("history_id") % 4 == 1, F.array(header("From"), header("List-Id")))
    return filters.bulk(table(spark, sf, "messages").withColumn("headers", headers)).select("id")


@_R.query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderpriority = '1-URGENT')")
def owned_through_parent(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return filters.through_parent(lines, table(spark, sf, "orders"), "l_orderkey", "o_orderkey", "o_orderpriority", "1-URGENT")


@_R.query("SELECT m.id FROM messages m LEFT JOIN (SELECT id AS sid, message_id, CASE WHEN id % 2 = 0 THEN 'new' ELSE 'old' END AS model FROM attachments) s ON s.message_id = m.id AND s.model = 'new' WHERE s.sid IS NULL", "messages", "attachments")
def summaries_missing(spark: SparkSession, sf: str) -> DataFrame:
    made = table(spark, sf, "attachments").select(F.col("message_id").alias("id"), F.when(F.col("id") % 2 == 0, "new").otherwise("old").alias("model"))
    return filters.missing_under(table(spark, sf, "messages").select("id"), made, "id", model="new")


@_R.query("SELECT email, count(*) AS messages, max(date) AS last FROM (SELECT DISTINCT lower(trim(split_part(split_part(from_addr, '<', 2), '>', 1))) AS email FROM messages WHERE history_id % 7 = 0) JOIN messages ON contains(lower(from_addr), '<' || email) GROUP BY email", "messages")
def contacts_in_senders(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "messages")
    contacts = m.where("history_id % 7 = 0").select(F.lower(F.regexp_extract("from_addr", "<([^>]*)>", 1)).alias("email"))
    return filters.contact_matches(contacts, m)


_BULK = " OR ".join(_HAS(x) for x in ("CATEGORY_PROMOTIONS", "CATEGORY_UPDATES", "CATEGORY_SOCIAL", "CATEGORY_FORUMS"))


@_R.query(f"SELECT id AS thread_id, count(*) AS n FROM messages GROUP BY 1 HAVING bool_and({_BULK})", "messages")
def bulk_threads(spark: SparkSession, sf: str) -> DataFrame:
    """Each message is its own thread here, so that some threads are all bulk."""
    return filters.bulk_threads(table(spark, sf, "messages").withColumn("thread_id", F.col("id")))


_W = "list_filter(regexp_split_to_array(lower({f}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')"


def _field_sql(name: str, source: str, field: str) -> str:
    """SQL for one field: a row each with length, term counts and phrase count, and the one row of the table's sums."""
    words = f"SELECT id, regexp_extract_all(lower(coalesce({field}, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {source}"
    counts = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS t{k}" for k, t in enumerate(PAIR))
    phrase = f"len(string_split(' ' || array_to_string(w, '  ') || ' ', ' {'  '.join(PAIR)} ')) - 1 AS ph"
    sums = ", ".join(f"count(*) FILTER (WHERE t{k} > 0) AS d{k}" for k in range(len(PAIR)))
    idf = [f"ln(1 + (n - d{k} + 0.5) / (d{k} + 0.5))" for k in range(len(PAIR))]
    part = lambda tf: f"{tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * dl / nullif(avgdl, 0)))"
    either = " + ".join(f"coalesce({i} * {part(f't{k}')}, 0)" for k, i in enumerate(idf))
    return f"{name} AS (SELECT id, {either} AS any_, coalesce(({' + '.join(idf)}) * {part('ph')}, 0) AS phrase FROM (SELECT *, count(*) OVER () AS n, avg(dl) OVER () AS avgdl, {sums.replace('AS', 'OVER () AS')} FROM (SELECT id, len(w) AS dl, {counts}, {phrase} FROM ({words}))))"


_FIELDS = {"messages": search.MESSAGE_FIELDS, "attachments": search.ATTACHMENT_FIELDS}
_PARTS = [_field_sql(f"{s}_{f}", s, f) for s, fields in _FIELDS.items() for f in fields]
_SUMS = [
    f"{s}_all AS (SELECT id, {' + '.join(f'{s}_{f}.any_' for f in fields)} AS any_, {' + '.join(f'{s}_{f}.phrase' for f in fields)} AS phrase FROM {s}_{fields[0]} {' '.join(f'JOIN {s}_{f} USING (id)' for f in fields[1:])})"
    for s, fields in _FIELDS.items()
]


@_R.query(
    f""", {', '.join([*_PARTS, *_SUMS])}, hit AS (SELECT id, greatest(any_, 1.5 * phrase) AS s FROM messages_all WHERE any_ > 0
      UNION ALL SELECT message_id, greatest(any_, 1.5 * phrase) FROM attachments_all JOIN attachments USING (id) WHERE any_ > 0),
    best AS (SELECT id, max(s) AS s FROM hit GROUP BY id)
    SELECT id, round(CASE WHEN max(s) OVER () > min(s) OVER () THEN (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) ELSE 1 END, 6) AS score FROM best""",
    "messages", "attachments",
)
def text_search(spark: SparkSession, sf: str) -> DataFrame:
    """Messages by words and phrase over all their fields and those of their attachments, scaled to 0..1."""
    m, a = table(spark, sf, "messages"), table(spark, sf, "attachments")
    return search.text_search(index_of(spark, "messages", m, "id", search.MESSAGE_FIELDS), index_of(spark, "attachments", a, "id", search.ATTACHMENT_FIELDS), a, PAIR)


QUESTION = "what are the tion and eron blees"


def fact_scores(floor: float = 0.1) -> str:
    """SQL for the facts a search finds, as a query with views of its own before it."""
    terms = facts.fact_terms(QUESTION)
    counts = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS t{k}" for k, t in enumerate(terms))
    sums = ", ".join(f"count(*) FILTER (WHERE t{k} > 0) OVER () AS d{k}" for k in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - d{k} + 0.5) / (d{k} + 0.5)) * t{k} * 2.2 / (t{k} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for k in range(len(terms)))
    length = f"(sqrt(list_sum(list_transform([{','.join(map(str, QUERY_VECTOR))}]::DOUBLE[], lambda x: x * x))) + 1e-8)"
    own = "(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) + 1e-8)"
    return f"""WITH sem AS (SELECT *, row_number() OVER (ORDER BY cosine DESC, id) AS sem FROM (SELECT *, round({_DOT.format(v='embedding')} / {own} / {length}, 6) AS cosine FROM propositions)),
    bm AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS word FROM (SELECT id, round({score}, 6) AS s FROM (SELECT *, count(*) OVER () AS n, avg(dl) OVER () AS avgdl, {sums} FROM
      (SELECT id, len(w) AS dl, {counts} FROM (SELECT id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM propositions)))) WHERE s > 0),
    f AS (SELECT sem.id, text, cosine, word IS NOT NULL AS bm25, contains(lower(text), 'hands') AS owner, round(1 / (60 + sem) + coalesce(1 / (60 + word), 0) + CASE WHEN contains(lower(text), 'hands') THEN 0.02 ELSE 0 END, 9)::DOUBLE AS rrf
      FROM sem LEFT JOIN bm USING (id) WHERE cosine >= {floor} OR word IS NOT NULL)
    SELECT id, cosine, bm25, owner, rrf FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY rrf DESC, id) AS nth FROM f) WHERE nth = 1 ORDER BY rrf DESC, id LIMIT 500"""


@_R.query(", " + fact_scores().removeprefix("WITH "), "messages", "propositions")
def facts_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    found = facts.find_facts(table(spark, sf, "propositions"), QUESTION, QUERY_VECTOR, floor=0.1, owner=("hands",))
    return found.select("id", "cosine", "bm25", "owner", "rrf")


