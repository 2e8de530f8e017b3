"""Messages, files, invitations, facts and query words over whole tables: each input is composed from the tables as an API or a mailbox would give it."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import cleaning
from threadloom.operators import facts, filters
from threadloom.plans.mail_queries import QUERY_VECTOR
from threadloom.plans.registry import Registry
from threadloom.plans.search_queries import fact_scores
from threadloom.sources import files, mime
from threadloom.sources.mail import table, with_views

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.oracle


def _coded(text: Column) -> Column:
    """URL-safe base64 without padding, as mail APIs send it."""
    return F.regexp_replace(F.translate(F.base64(F.encode(text, "UTF-8")), "+/", "-_"), r"[=\r\n]", "")


def _leaf(kind: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("mimeType"), F.struct(_coded(text).alias("data")).alias("body"))


def api_messages(m: DataFrame) -> DataFrame:
    """(history_id, raw): messages as an API's JSON, in five shapes by history id: flat, alternatives, parts nine deep, two texts and a file, without a readable date."""
    at = F.to_timestamp(F.substring("date", 1, 19), "yyyy-MM-dd'T'HH:mm:ss")
    mailed = F.concat(F.date_format(at, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    named = lambda *pairs: F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in pairs))
    heads = [("FROM", F.col("from_addr")), ("to", F.col("to_addr")), ("Subject", F.col("subject"))]
    plain = _leaf("text/plain", F.col("body_text"))
    file = F.struct(F.lit("application/pdf").alias("mimeType"), F.concat("id", F.lit(".pdf")).alias("filename"), F.struct(F.concat(F.lit("at"), "id").alias("attachmentId"), F.lit(12).alias("size")).alias("body"))
    deep = F.to_json(plain)
    for _ in range(9):
        deep = F.concat(F.lit('{"mimeType":"multipart/mixed","parts":['), deep, F.lit("]}"))
    parts = F.when(F.col("kind") == 1, F.concat(F.lit("["), F.to_json(plain), F.lit(","), F.to_json(_leaf("text/html", F.concat(F.lit("<p>"), "subject", F.lit("</p>")))), F.lit("]")))
    parts = parts.when(F.col("kind") == 2, F.concat(F.lit("["), deep, F.lit("]")))
    parts = parts.when(F.col("kind") == 3, F.concat(F.lit("["), F.to_json(plain), F.lit(","), F.to_json(_leaf("text/plain", F.lit("second"))), F.lit(","), F.to_json(file), F.lit("]")))
    dated = F.when(F.col("kind") == 1, F.to_json(named(*heads, ("Received", F.lit("by x")), ("Received", F.concat(F.lit("by y; "), mailed, F.lit(" (UTC)"))), ("Date", F.lit("Fri, 3 Apr 2026 01:02:03 +0000")))))
    dated = dated.when(F.col("kind") == 2, F.to_json(named(*heads, ("Date", mailed)))).when(F.col("kind") == 4, F.to_json(named(*heads, ("Date", F.lit("04-03-2026"))))).otherwise(F.to_json(named(*heads)))
    flat = F.concat(F.lit('"mimeType":"text/plain","body":'), F.get_json_object(F.to_json(plain), "$.body"))
    payload = F.concat(F.lit('{"headers":'), dated, F.lit(","), F.when(parts.isNotNull(), F.concat(F.lit('"mimeType":"multipart/mixed","parts":'), parts)).otherwise(flat), F.lit("}"))
    internal = F.when(F.col("kind").isin(0, 3), F.unix_millis(at).cast("string")).when(F.col("kind") == 1, "0")
    top = F.to_json(F.struct("id", F.col("thread_id").alias("threadId"), internal.alias("internalDate"), F.col("history_id").cast("string").alias("historyId"), F.col("labels").alias("labelIds")))
    raw = F.concat(F.substring(top, F.lit(1), F.length(top) - 1), F.lit(',"payload":'), payload, F.lit("}"))
    return m.withColumn("kind", F.col("history_id") % 5).select("history_id", raw.alias("raw"))


@_R.query(
    """SELECT id, thread_id, from_addr, to_addr, subject, md5(body_text || CASE WHEN history_id % 5 = 3 THEN chr(10) || 'second' ELSE '' END) AS body_text, CASE WHEN history_id % 5 = 1 THEN '<p>' || subject || '</p>' ELSE '' END AS body_html,
      CASE WHEN history_id % 5 = 4 THEN '1970-01-01 00:00:00' ELSE replace(left(date, 19), 'T', ' ') END AS sent, labels_csv AS labels, history_id, CASE WHEN history_id % 5 = 3 THEN id || '.pdf' ELSE '' END AS files FROM messages""",
    "messages",
)
def messages_parsed(spark: SparkSession, sf: str) -> DataFrame:
    raw = api_messages(table(spark, sf, "messages"))
    at = F.date_format(F.to_utc_timestamp("date", F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
    names = F.array_join(F.transform("attachments", lambda a: a["filename"]), " ")
    got = mime.parse(raw)
    return got.select("id", "thread_id", "from_addr", "to_addr", "subject", F.md5("body_text").alias("body_text"), "body_html", at.alias("sent"), F.array_join("labels", ",").alias("labels"), "history_id", names.alias("files"))


def _zipped(pages: DataFrame) -> DataFrame:
    """(path, content) archives of two readable files, one outside the folder and one of no known kind."""

    def run(batches):
        for batch in batches:
            out = []
            for page, text in zip(batch["page_id"], batch["text"], strict=True):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as z:
                    for name, content in ((f"{page}.txt", text), ("../up.txt", "no"), ("a/rows.csv", f"a,b\n{page},2"), ("x.exe", "no")):
                        z.writestr(name, content)
                out.append(held.getvalue())
            yield pd.DataFrame({"page_id": batch["page_id"], "content": out})

    return pages.mapInPandas(run, "page_id long, content binary")


_FILES = """SELECT p.page_id, html, text, CASE page_id % 7 WHEN 0 THEN 'p.html' WHEN 1 THEN 'p.HTM' WHEN 2 THEN 't.txt' WHEN 3 THEN 'r.csv' WHEN 4 THEN 'e.ics' WHEN 5 THEN 'b.bin' ELSE 'z.zip' END AS name,
  CASE page_id % 7 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 4 THEN 'text/calendar' WHEN 1 THEN 'application/octet-stream' END AS mime FROM pages p JOIN documents d ON d.doc_id = p.page_id"""
_PAGE_TEXT = "regexp_replace(regexp_replace(regexp_replace(html, '<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'gs'), '<[^>]*>', ' ', 'g'), '&copy;', '©', 'g')"
_PAGE_TEXT = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_PAGE_TEXT}, '&middot;', '·', 'g'), '&quot;', '\"', 'g'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))"


@_R.query(
    f"""WITH g AS ({_FILES}) SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'html' WHEN 1 THEN 'html' WHEN 2 THEN 'text' WHEN 3 THEN 'table' WHEN 4 THEN 'calendar' WHEN 6 THEN 'archive' END AS kind, md5(CASE page_id % 7 WHEN 2 THEN left(trim(text, ' ' || chr(10)), 50000)
      WHEN 3 THEN 'a,b' || repeat(chr(10) || page_id || ',2', 499) WHEN 4 THEN 'Event: ' || page_id || ' lunch, please' || chr(10) || 'Start: 20260405T120000Z' || chr(10) || 'Attendees: mailto:a@b, mailto:c@d' || chr(10) || 'Description: ' || left(regexp_replace(text, '\\s+', ' ', 'g'), 500)
      WHEN 6 THEN '[' || page_id || '.txt]' || chr(10) || left(trim(text, ' ' || chr(10)), 50000) || chr(10) || chr(10) || '[a/rows.csv]' || chr(10) || 'a,b' || chr(10) || page_id || ',2' WHEN 5 THEN NULL ELSE left({_PAGE_TEXT}, 50000) END) AS text FROM g"""
)
def files_extracted(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of files by type or ending: pages as HTML, documents as text and in archives, rows, calendar events, and a kind nobody reads."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    p = table(spark, sf, "pages").join(d, F.col("doc_id") == F.col("page_id")).withColumn("k", F.col("page_id") % 7)
    kinds = F.array(*map(F.lit, ("p.html", "p.HTM", "t.txt", "r.csv", "e.ics", "b.bin", "z.zip")))
    types = F.when(F.col("k") == 0, "text/html; charset=utf-8").when(F.col("k") == 4, "text/calendar").when(F.col("k") == 1, "application/octet-stream")
    rows = F.concat(F.lit("a,b"), F.repeat(F.concat(F.lit("\n"), "page_id", F.lit(",2")), F.lit(700)))
    event = F.concat(
        F.lit("BEGIN:VCALENDAR\nBEGIN:VEVENT\nSUMMARY:"), "page_id", F.lit(" lun\n ch\\, please\nDTSTART:20260405T120000Z\nATTENDEE;CN=x:mailto:a@b\nATTENDEE:mailto:c@d\nDESCRIPTION:"), F.regexp_replace("text", r"\s+", " "), F.lit("\nEND:VEVENT\nEND:VCALENDAR")
    )
    said = F.when(F.col("k") <= 1, F.col("html")).when(F.col("k") == 2, F.col("text")).when(F.col("k") == 3, rows).when(F.col("k") == 4, event).otherwise(F.lit("x"))
    plain = p.where("k <> 6").select("page_id", "k", types.alias("mime"), F.encode(said, "UTF-8").alias("content"))
    packed = _zipped(p.where("k = 6").select("page_id", "text")).select("page_id", F.lit(6).cast("long").alias("k"), F.lit(None).cast("string").alias("mime"), "content")
    every = plain.unionByName(packed).withColumn("path", F.concat("page_id", F.lit("/"), F.get(kinds, F.col("k").cast("int"))))
    got = files.extracted(every, mime="mime")
    return got.select(F.split_part("path", F.lit("/"), F.lit(1)).cast("long").alias("page_id"), "kind", F.md5("text").alias("text"))


_INVITED = """SELECT id, CASE history_id % 9 WHEN 0 THEN 'E <e@mg.evite.com>' WHEN 1 THEN 'N <n@notevite.com>' WHEN 2 THEN 'C <Calendar-Notification@google.com>' ELSE from_addr END AS from_addr, CASE WHEN history_id % 9 = 3 THEN 'Please RSVP: ' || subject WHEN history_id % 9 = 4 THEN NULL ELSE subject END AS subject,
  CASE history_id % 9 WHEN 5 THEN body_text || ' You''re invited!' WHEN 6 THEN NULL ELSE body_text END AS body_text, history_id FROM messages"""
_CALENDARS = "SELECT message_id, CASE id % 5 WHEN 0 THEN 'Plan.ICS' ELSE filename END AS filename, CASE id % 5 WHEN 1 THEN 'text/Calendar; method=REQUEST' WHEN 2 THEN NULL ELSE mime_type END AS mime_type FROM attachments"


@_R.query(
    f""", g AS ({_INVITED}), a AS ({_CALENDARS}) SELECT id FROM g WHERE history_id % 9 IN (0, 2, 3, 5) OR EXISTS (SELECT 1 FROM a WHERE message_id = g.id AND (filename LIKE '%.ICS' OR mime_type LIKE 'text/Calendar%'))
      OR regexp_matches(lower(coalesce(subject, '') || chr(10) || coalesce(body_text, '')), '{"|".join(p.replace("'", "''") for p in filters.INVITING)}')""",
    "messages", "attachments",
)
def invitations(spark: SparkSession, sf: str) -> DataFrame:
    """Messages that may be invitations by sender, words, or an attached calendar entry."""
    m, a = table(spark, sf, "messages"), table(spark, sf, "attachments")
    k, j = F.col("history_id") % 9, F.col("id") % 5
    sender = F.when(k == 0, "E <e@mg.evite.com>").when(k == 1, "N <n@notevite.com>").when(k == 2, "C <Calendar-Notification@google.com>").otherwise(F.col("from_addr"))
    subject = F.when(k == 3, F.concat(F.lit("Please RSVP: "), "subject")).when(k != 4, F.col("subject"))
    body = F.when(k == 5, F.concat("body_text", F.lit(" You're invited!"))).when(k != 6, F.col("body_text"))
    files_of = a.select("message_id", F.when(j == 0, "Plan.ICS").otherwise(F.col("filename")).alias("filename"), F.when(j == 1, "text/Calendar; method=REQUEST").when(j != 2, F.col("mime_type")).alias("mime_type"))
    return filters.invitations(m.withColumns({"from_addr": sender, "subject": subject, "body_text": body}), files_of).select("id")


NEAR = 0.1
_COLLAPSE = f"""RECURSIVE_ f AS (SELECT *, row_number() OVER (ORDER BY rrf DESC, id) AS nth FROM (FACTS)),
told AS (SELECT f.nth, f.id, list_distinct(list_filter(regexp_extract_all(lower(p.text), '[a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains([{', '.join("'" + w.replace("'", "''") + "'" for w in sorted(cleaning.STOP_WORDS))}], w))) AS words, list_sort(list_distinct(regexp_extract_all(lower(p.text), '{cleaning.VALUE}'))) AS vals,
  list_transform(p.embedding, lambda x: x::DOUBLE / (sqrt(list_sum(list_transform(p.embedding, lambda y: y::DOUBLE * y))) + 1e-8)) AS v FROM f JOIN propositions p USING (id)),
near AS (SELECT a.nth, list(b.nth ORDER BY b.nth) FILTER (WHERE list_dot_product(a.v, b.v) >= {NEAR} AND list_has_any(a.words, b.words) AND a.vals = b.vals) AS of FROM told a LEFT JOIN told b ON b.nth < a.nth GROUP BY a.nth),
walk AS (SELECT 0::BIGINT AS nth, []::BIGINT[] AS kept, NULL::BIGINT AS into_ UNION ALL SELECT n.nth, CASE WHEN list_has_any(kept, coalesce(of, [])) THEN kept ELSE list_append(kept, n.nth) END, list_min(list_intersect(kept, coalesce(of, []))) FROM walk JOIN near n ON n.nth = walk.nth + 1)
SELECT id, (SELECT count(*) FROM walk w WHERE w.into_ = f.nth) AS dup_count FROM f JOIN walk USING (nth) WHERE into_ IS NULL"""


@_R.query()
def facts_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    """Facts a search finds, each once: here texts count as near from a cosine of 0.1 on, as these vectors lie far apart."""
    found = facts.find_facts(table(spark, sf, "propositions"), "what are the tion and eron blees", QUERY_VECTOR, floor=-1.0, owner=("hands",))
    return facts.collapse_near_duplicates(found, NEAR).select("id", "dup_count")


ORACLE_SQL["facts_collapsed"] = with_views(", " + _COLLAPSE.replace("RECURSIVE_ ", "").replace("FACTS", fact_scores(-1.0)), "messages", "propositions").replace("WITH ", "WITH RECURSIVE ", 1)

_STOPPED = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(cleaning.STOP_WORDS))


@_R.query(
    f"""WITH g AS (SELECT conv_id, turn, text || CASE turn % 4 WHEN 0 THEN ' latest notes, classes' WHEN 1 THEN ' what batteries do I own this Week' WHEN 2 THEN ' address boxes recently' ELSE ' cars last year' END AS q FROM conversations),
    t AS (SELECT *, list_filter(regexp_extract_all(lower(q), '[a-z0-9]+'), lambda w: length(w) > 1 AND NOT list_contains([{_STOPPED}], w)) AS terms FROM g)
    SELECT conv_id, turn, array_to_string(terms, ' ') AS terms, array_to_string(list_filter(list_transform(terms, lambda w: CASE WHEN length(w) <= 3 OR regexp_matches(w, 'ss$') THEN NULL WHEN regexp_matches(w, 'ies$') THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '(ch|sh|x|s|z)es$') THEN left(w, -2) WHEN w LIKE '%s' THEN left(w, -1) END), lambda w: w IS NOT NULL), ' ') AS singulars,
      CASE turn % 4 WHEN 0 THEN 0.3 WHEN 1 THEN 0.3 WHEN 2 THEN 0.25 ELSE 0.15 END::DOUBLE AS boost FROM t"""
)
def query_words(spark: SparkSession, sf: str) -> DataFrame:
    """The telling words of what people ask, their singulars, and how much the question asks for recent mail."""
    more = F.array(F.lit(" latest notes, classes"), F.lit(" what batteries do I own this Week"), F.lit(" address boxes recently"), F.lit(" cars last year"))
    q = table(spark, sf, "conversations").select("conv_id", "turn", F.concat("text", F.get(more, (F.col("turn") % 4).cast("int"))).alias("q"))
    told = q.withColumn("terms", cleaning.terms_in(F.col("q")))
    singulars = F.filter(F.transform("terms", cleaning.singular_of), lambda w: w.isNotNull())
    return told.select("conv_id", "turn", F.array_join("terms", " ").alias("terms"), F.array_join(singulars, " ").alias("singulars"), cleaning.temporal_boost_of(F.col("q")).alias("boost"))
