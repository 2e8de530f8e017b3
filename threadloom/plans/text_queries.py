"""Queries for prompts, texts, chunks and what of a result is shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import chunking, cleaning, urls
from threadloom.operators import gate
from threadloom.plans.registry import Registry
from threadloom.sources import files
from threadloom.sources.mail import table, with_views
from threadloom.streaming.folders import new_folder

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.oracle


@_R.query("SELECT page_id, substr(concat('URL: ', url), 1, 500) AS name, url AS back, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host FROM pages")
def url_stub_names(spark: SparkSession, sf: str) -> DataFrame:
    name = urls.stub_name(F.col("url"))
    return table(spark, sf, "pages").select("page_id", name.alias("name"), urls.url_of_stub(name).alias("back"), urls.host_of(F.col("url")).alias("host"))


_BODY_SQL = "trim(regexp_replace(regexp_replace(body_text, 'https?://\\S+', '[link]', 'gi'), '\\n\\s*\\n\\s*\\n+', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13))"
_CUT_SQL = f"CASE WHEN length({_BODY_SQL}) > 15000 THEN left({_BODY_SQL}, 11000) || chr(10) || chr(10) || '[...]' || chr(10) || chr(10) || right({_BODY_SQL}, 4000) ELSE {_BODY_SQL} END"
_PROMPT_SQL = f"'From: ' || from_addr || chr(10) || 'Subject: ' || subject || chr(10) || chr(10) || {_CUT_SQL}"


@_R.query(f"SELECT id, md5(CASE WHEN length(p) > 16800 THEN left(p, 16797) || '...' ELSE p END) AS prompt FROM (SELECT id, {_PROMPT_SQL} AS p FROM messages)", "messages")
def prompts(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "messages")
    return m.select("id", F.md5(cleaning.prompt(F.col("from_addr"), F.col("subject"), F.col("body_text"))).alias("prompt"))


@_R.query("SELECT id, md5('From: ' || from_addr || ' | To: ' || to_addr || ' | Date: ' || substr(date, 1, 10) || ' | Subject: ' || subject || ' | ' || CASE WHEN length(t) > 50 THEN t ELSE body_text END) AS line FROM (SELECT *, trim(body_text, ' ' || chr(10) || chr(9) || chr(13)) AS t FROM messages)", "messages")
def message_texts(spark: SparkSession, sf: str) -> DataFrame:
    line = cleaning.message_text(F.col("from_addr"), F.col("to_addr"), F.substring("date", 1, 10), F.col("subject"), F.col("body_text"))
    return table(spark, sf, "messages").select("id", F.md5(line).alias("line"))


@_R.query("SELECT id, md5('Attachment: ' || filename || ' | From email: ' || subject || ' | ' || coalesce(extracted_text, '')) AS line FROM (SELECT a.*, m.subject FROM attachments a JOIN messages m ON m.id = a.message_id)", "messages", "attachments")
def attachment_texts(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "messages").select(F.col("id").alias("message_id"), "subject")
    line = cleaning.attachment_text(F.col("filename"), F.col("subject"), F.coalesce("extracted_text", F.lit("")))
    return table(spark, sf, "attachments").join(m, "message_id").select("id", F.md5(line).alias("line"))


@_R.query("SELECT doc_id, CASE WHEN length(text) // 4 > 100 THEN substr(text, 1, 400) ELSE text END AS head FROM documents")
def token_limited(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", cleaning.limited(F.col("text"), 100).alias("head"))


@_R.query("SELECT doc_id, string_agg(chunk, chr(10) || chr(10) ORDER BY place) = text AS whole, count(*) = 1 AS one FROM (SELECT doc_id, text, 0 AS place, text AS chunk FROM documents WHERE length(text) // 4 <= 500) GROUP BY doc_id, text")
def chunks_lateral(spark: SparkSession, sf: str) -> DataFrame:
    """``chunk_text`` in SQL: texts of at most 500 tokens are one chunk, themselves."""
    chunking.register(spark)
    table(spark, sf, "documents").createOrReplaceTempView("documents")
    return spark.sql("SELECT doc_id, concat_ws('', collect_list(t.chunk)) = first(text) AS whole, count(*) = 1 AS one FROM documents, LATERAL chunk_text(text) t WHERE length(text) DIV 4 <= 500 GROUP BY doc_id")


@_R.query("SELECT page_id, k::INTEGER AS place, CASE k WHEN 0 THEN url ELSE 'https://more.example/' || page_id END AS url FROM pages, (VALUES (0), (1)) v(k)")
def urls_lateral(spark: SparkSession, sf: str) -> DataFrame:
    """``extract_urls`` in SQL over texts with each page's address twice and another one."""
    chunking.register(spark)
    table(spark, sf, "pages").createOrReplaceTempView("pages")
    return spark.sql("SELECT page_id, t.place, t.url FROM (SELECT page_id, concat('See ', url, ', ', url, '; https://more.example/', page_id, '.') AS body FROM pages), LATERAL extract_urls(body) t")


def _plain_sql(source: str) -> str:
    """SQL for a page's text: tags are gaps, the character references these pages hold are read, white space is collapsed."""
    out = f"regexp_replace({source}, '<[^>]*>', ' ', 'g')"
    for mark, sign in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;?", "&")):
        out = f"regexp_replace({out}, '{mark}', '{sign}', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


_SEEN = "regexp_replace(html, '<script.*?</script>|<style.*?</style>|<!--.*?-->|<title>.*?</title>', '', 'gs')"


@_R.query(
    f"""WITH p AS (SELECT page_id, {_plain_sql("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")} AS title, {_plain_sql("regexp_extract(html, '<article>(.*?)</article>', 1, 's')")} AS own, {_plain_sql(_SEEN)} AS whole FROM pages)
    SELECT page_id, title || chr(10) || chr(10) || CASE WHEN length(own) >= 250 THEN own ELSE whole END AS text FROM p"""
)
def pages_main_text(spark: SparkSession, sf: str) -> DataFrame:
    """Title and main text of every page, the whole body where the main part is short."""
    return files.main_texts(table(spark, sf, "pages"))


@_R.query()
def message_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every message in chunks, later ones with their message's sender and subject in front; tests hold it against the rule."""
    m = table(spark, sf, "messages")
    text = cleaning.message_text(F.col("from_addr"), F.col("to_addr"), F.substring("date", 1, 10), F.col("subject"), F.col("body_text"))
    own = m.select("id", "from_addr", "subject", F.posexplode(chunking.chunks(text)).alias("place", "chunk"))
    chunk = cleaning.chunk_in_context(cleaning.limited(F.col("chunk"), 2048), F.col("place"), F.col("from_addr"), F.col("subject"))
    kind = F.when(F.col("place") == 0, "message").otherwise(F.concat(F.lit("message_chunk_"), F.col("place")))
    return own.select("id", kind.alias("chunk_type"), F.substring(chunk, 1, 500).alias("chunk_text"))


@_R.query("SELECT doc_id, length(text) AS length, CASE WHEN length(text) > 500 THEN substr(text, 1, 468) || '… [truncated: original ' || length(text) || ' chars]' ELSE text END AS text FROM documents")
def cells_clipped(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("length"), "text")
    return gate.clipped_cells(d, 500)


@_R.query("SELECT id || ' ' || subject AS ref FROM messages", "messages")
def detail_refs(spark: SparkSession, sf: str) -> DataFrame:
    return gate.detail(table(spark, sf, "messages"), "refs", "id", "subject", "body_text")


@_R.query("SELECT id, subject, substr(body_text, 1, 200) AS snippet FROM messages", "messages")
def detail_snippets(spark: SparkSession, sf: str) -> DataFrame:
    return gate.detail(table(spark, sf, "messages"), "snippet", "id", "subject", "body_text")


@_R.query("SELECT m.id, subject, coalesce(a.filename, substr(body_text, 1, 200)) AS summary FROM messages m LEFT JOIN attachments a ON a.message_id = m.id", "messages", "attachments")
def detail_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Messages with what sums them up (here their link's name), or their first characters."""
    own = table(spark, sf, "attachments").select(F.col("message_id").alias("id"), F.col("filename").alias("summary"))
    return gate.detail(table(spark, sf, "messages").join(own, "id", "left"), "summary", "id", "subject", "body_text", summary="summary")


@_R.query("SELECT thread_id, array_to_string(list(id ORDER BY date DESC, id)[:2], ' ') AS matches, count(*) > 2 AS matches_truncated FROM messages GROUP BY thread_id", "messages")
def detail_first_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Each thread's two newest messages and whether there are more."""
    own = table(spark, sf, "messages").groupBy("thread_id").agg(F.sort_array(F.collect_list(F.struct("date", (-F.col("history_id")).alias("less"), "id")), False).alias("m"))
    return gate.first_matches(own.select("thread_id", F.transform("m", lambda x: x["id"]).alias("matches")), "matches", 2).withColumn("matches", F.array_join("matches", " "))


_GUEST = """WITH late AS (SELECT thread_id, max(date) AS last, count(*) AS n FROM messages GROUP BY thread_id HAVING count(*) > 1)
SELECT m.id, replace(m.subject, 'a', 'A') AS subject, l.n, coalesce(a.size_bytes, 0) AS size FROM messages m JOIN late l ON l.thread_id = m.thread_id AND m.date = l.last LEFT JOIN attachments a ON a.message_id = m.id
WHERE NOT EXISTS (SELECT 1 FROM attachments x WHERE x.message_id = m.id AND x.crawl_attempts > 6) AND length(m.body_text) > (SELECT avg(length(body_text)) / 4 FROM messages)"""
_TENANTS = ("u0", "u1", "u2")


@_R.query("WITH t AS (SELECT NULL) SELECT 1")
def guest_sql(spark: SparkSession, sf: str) -> DataFrame:
    """One query of guests' own, as each tenant sees it; messages are joined once and not for each tenant and mention."""
    messages = gate.by_owner(table(spark, sf, "messages"), f"{new_folder(spark, 'guests')}/messages")
    tables = {"messages": messages, "attachments": table(spark, sf, "attachments", messages=messages)}
    parts = [gate.query(spark, _GUEST, tables, user).withColumn("tenant", F.lit(user)) for user in _TENANTS]
    return parts[0].union(parts[1]).union(parts[2])


# the same text over each tenant's rows alone
ORACLE_SQL["guest_sql"] = with_views("", "messages", "attachments") + "".join(f", messages_{u} AS (SELECT * FROM messages WHERE user_id = '{u}'), attachments_{u} AS (SELECT * FROM attachments WHERE user_id = '{u}')" for u in _TENANTS) + " " + " UNION ALL ".join(
    "SELECT *, '{u}' AS tenant FROM ({q})".format(u=u, q=_GUEST.replace("FROM messages", f"FROM messages_{u}").replace("attachments a", f"attachments_{u} a").replace("attachments x", f"attachments_{u} x")) for u in _TENANTS
)
