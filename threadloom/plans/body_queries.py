"""Links, quotes, prompts, replies and other parts of message bodies over whole tables.

Bodies with wrapped links, quotes or replies are composed in SQL that Spark and DuckDB both
read, so each query works on as many rows as its table has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import cleaning, urls
from threadloom.plans.registry import Registry

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.oracle
_joined = lambda c: F.array_join(c, " ")


def _swapped(text: str, pairs: dict[str, str]) -> str:
    """SQL that replaces one thing after another."""
    return reduce(lambda s, kv: f"replace({s}, '{kv[0]}', '{kv[1]}')", pairs.items(), text)


def _escaped(text: str) -> str:
    return _swapped(text, {"%": "%25", ":": "%3A", "/": "%2F", "?": "%3F", "=": "%3D", "&": "%26", "#": "%23"})


_V2 = "'https://urldefense.proofpoint.com/v2/url?u=' || " + _swapped("url", {"%": "-25", "-": "-2D", "_": "-5F", ":": "-3A", "/": "_", "?": "-3F", "=": "-3D", "&": "-26", "#": "-23"}) + " || '&d=x'"
_V3 = "'https://urldefense.com/v3/__' || url || '__;!!abc$'"
_SAFE = "'https://nam02.safelinks.protection.outlook.com/?url=' || " + _escaped("url") + " || '&data=1'"
_NESTED = "'https://x.safelinks.protection.outlook.com/?data=1&url=' || " + _escaped(f"({_V3})")
_SEARCHED = "'https://www.google.com/url?sa=t&q=' || " + _escaped("url")
_FOREIGN = "'https://site.example/share?url=' || " + _escaped("url")
_BARE = "replace(split_part(url, '#', 1), '?utm_source=feed', '')"
_MARK = f"CASE WHEN contains({_BARE}, '?') THEN '&' ELSE '?' END"
_TAIL = "CASE WHEN contains(url, '#') THEN '#' || split_part(url, '#', 2) ELSE '' END"
_CLEAN = f"({_BARE} || {_TAIL})"


@_R.over(
    "SELECT page_id, url AS bare, url || CASE page_id % 8 WHEN 0 THEN '.' WHEN 1 THEN ')' WHEN 2 THEN '.,' WHEN 3 THEN ')).,' WHEN 4 THEN '?!\"' WHEN 5 THEN '_(x)' WHEN 6 THEN ']>' ELSE '' END AS url FROM pages",
    "SELECT page_id, CASE WHEN page_id % 8 = 5 THEN bare || '_(x)' ELSE bare END AS bare FROM g",
)
def url_trimmed(g: DataFrame) -> DataFrame:
    return g.select("page_id", urls.trimmed(F.col("url")).alias("bare"))


@_R.over(
    f"SELECT page_id, url, CASE page_id % 7 WHEN 0 THEN {_V2} WHEN 1 THEN {_V3} WHEN 2 THEN {_SAFE} WHEN 3 THEN {_NESTED} WHEN 4 THEN {_SEARCHED} WHEN 5 THEN {_FOREIGN} ELSE url END AS wrapped FROM pages",
    "SELECT page_id, CASE WHEN page_id % 7 = 5 THEN wrapped ELSE url END AS target FROM g",
)
def url_unwrapped(g: DataFrame) -> DataFrame:
    return g.select("page_id", urls.unwrapped(F.col("wrapped")).alias("target"))


_TRACKED = f"split_part(url, '#', 1) || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || CASE page_id % 3 WHEN 0 THEN 'utm_source=x&GCLID=2' WHEN 1 THEN 'id=1&utm_Medium=y&z=3' ELSE 'fbclid=a' END || {_TAIL}"


@_R.over(f"SELECT page_id, url, {_TRACKED} AS tracked FROM pages", f"SELECT page_id, {_BARE} || CASE WHEN page_id % 3 = 1 THEN {_MARK} || 'id=1&z=3' ELSE '' END || {_TAIL} AS clean FROM g")
def url_without_trackers(g: DataFrame) -> DataFrame:
    return g.select("page_id", urls.without_trackers(F.col("tracked")).alias("clean"))


def _any(test: str, values: tuple[str, ...]) -> str:
    return "(" + " OR ".join(test.format(v) for v in values) + ")"


_HOST = "lower(split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1))"
_AFTER = f"lower(substr(split_part(url, '#', 1), strpos(url, '://') + 3 + length({_HOST})))"
_HOST_DENIED = f"({_HOST} IN ({', '.join(map(repr, urls.DENIED_HOSTS))}) OR {_any(_HOST.replace('{', '{{') + ' ^@ ' + chr(39) + '{}' + chr(39), urls.DENIED_HOST_STARTS)} OR {_any('(' + chr(39) + '.' + chr(39) + ' || ' + _HOST + ') LIKE ' + chr(39) + '%.{}' + chr(39), urls.DENIED_DOMAINS)})"
_PATH_DENIED = _any(f"contains({_AFTER}, '{{}}')", urls.DENIED_PATHS)
_ENDING_DENIED = _any(f"split_part({_AFTER}, '?', 1) LIKE '%{{}}'", urls.DENIED_ENDINGS)
_OTHER = f"substr(url, strpos(url, '://') + 3 + length({_HOST}))"


@_R.over(
    f"""SELECT page_id, CASE page_id % 8 WHEN 0 THEN replace(url, '://', '://click.') WHEN 1 THEN replace(url, {_HOST}, 'www.youtube.com') WHEN 2 THEN replace(url, {_HOST}, 'notyoutube.com') WHEN 3 THEN replace(url, {_HOST}, 'bit.ly')
      WHEN 4 THEN split_part(url, '?', 1) || '/unsubscribe?u=1' WHEN 5 THEN split_part(split_part(url, '#', 1), '?', 1) || '/pic.JPG?x=1' WHEN 6 THEN upper(url) ELSE url END AS url FROM pages""",
    f"SELECT page_id, {_HOST_DENIED} AS host, {_PATH_DENIED} AS path, {_ENDING_DENIED} AS ending FROM g",
)
def url_crawl_denied(g: DataFrame) -> DataFrame:
    u = F.col("url")
    return g.select("page_id", urls.host_denied(u).alias("host"), urls.path_denied(u).alias("path"), urls.ending_denied(u).alias("ending"))


_TWELVE, _SIXTY = (" ".join(f"https://many.example/{k}" for k in range(n)) for n in (12, 60))


@_R.over(
    f"""SELECT p.page_id, url, labels_csv, substr(body_text, 1, 100) || ' See ' || {_TRACKED} || ', (' || url || ') and https://t.co/' || cast(page_id AS varchar(20)) || ' or <' || {_SAFE} || '>. ' ||
      CASE WHEN page_id % 4 = 0 THEN '{_TWELVE}' WHEN page_id % 11 = 1 THEN '{_SIXTY}' ELSE '' END AS body FROM pages p JOIN messages m ON m.history_id = p.page_id""",
    f"""SELECT page_id, CASE WHEN page_id % 4 <> 0 AND page_id % 11 = 1 THEN '' WHEN page_id % 4 = 0 AND contains(labels_csv, 'CATEGORY_PROMOTIONS') THEN ''
      ELSE trim(CASE WHEN {_HOST_DENIED} OR {_PATH_DENIED} OR {_ENDING_DENIED} THEN '' ELSE CASE WHEN page_id % 3 = 1 THEN {_BARE} || {_MARK} || 'id=1&z=3' || {_TAIL} || ' ' ELSE '' END || {_CLEAN} || ' ' END || CASE WHEN page_id % 4 = 0 THEN '{_TWELVE}' ELSE '' END) END AS links FROM g""",
    "messages",
)
def url_crawlable(g: DataFrame) -> DataFrame:
    return g.select("page_id", _joined(urls.crawlable(F.col("body"), F.split("labels_csv", ","))).alias("links"))


@_R.over(
    """SELECT doc_id, substr(text, 1, 200) || ' https://docs.google.com/document/d/' || md5(text) || '/edit and https://drive.google.com/open?id=' || md5(text) || CASE WHEN doc_id % 2 = 0 THEN ' or drive.google.com/file/d/' || substr(md5(source), 1, 19) || '/view' ELSE ', https://drive.google.com/uc?x=1&id=' || md5(source) END AS body, text, source FROM documents""",
    "SELECT doc_id, md5(text) || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' ' || md5(source) END AS ids FROM g",
)
def drive_ids(g: DataFrame) -> DataFrame:
    return g.select("doc_id", _joined(urls.drive_ids(F.col("body"))).alias("ids"))


_BLANKS = "' ' || chr(10) || chr(9) || chr(13)"


@_R.over(
    """SELECT doc_id, text, CASE WHEN doc_id % 5 = 4 THEN substr(text, 1, 20) ELSE text END AS own, CASE doc_id % 5 WHEN 0 THEN text || chr(10) || 'On Mon, Jan 5, 2026 ' || source || ' wrote:' || chr(10) || 'old' WHEN 1 THEN text || chr(10) || '> ' || source || chr(10) || '  > more'
      WHEN 2 THEN text || chr(10) || '----- original message -----' || chr(10) || 'old' WHEN 3 THEN text || chr(10) || 'On x wrote:' || chr(10) || 'still' ELSE substr(text, 1, 20) || chr(10) || '> ' || replace(text, chr(10), chr(10) || ' > ') END AS body FROM documents""",
    f"SELECT doc_id, md5(CASE WHEN length(trim(own, {_BLANKS})) > 50 AND doc_id % 5 <> 3 THEN trim(own, {_BLANKS}) WHEN doc_id % 5 = 3 THEN trim(body, {_BLANKS}) ELSE body END) AS own FROM g",
)
def quoted_replies(g: DataFrame) -> DataFrame:
    return g.select("doc_id", F.md5(cleaning.before_replies(F.col("body"))).alias("own"))


_UNSEEN, _ONE_UNSEEN = "\u200b\u200b\ufeff\u00ad\u034f", "\u200b"


@_R.over(
    f"""SELECT p.page_id, text, 'Content-Type: text/plain; charset=utf-8' || chr(10) || 'content-transfer-encoding: 7bit' || chr(10) || 'Hello{_UNSEEN} there ' || url || ' and{_ONE_UNSEEN}one' || chr(10) || chr(10) || ' ' || chr(10) || chr(10) || text || '  ' AS body
      FROM pages p JOIN documents d ON d.doc_id = p.page_id""",
    f"""SELECT page_id, md5(trim(regexp_replace('Hello there [link] and{_ONE_UNSEEN}one' || chr(10) || chr(10) || text, '\\n\\s*\\n\\s*\\n+', chr(10) || chr(10), 'g'), {_BLANKS})) AS tidy FROM g""",
)
def bodies_tidied(g: DataFrame) -> DataFrame:
    return g.select("page_id", F.md5(cleaning.tidied(F.col("body"))).alias("tidy"))


@_R.over(
    "SELECT doc_id, split_part(text, '.', 1) AS a, split_part(text, '.', 2) AS b, text, split_part(text, '.', 1) || chr(10) || '  > ' || source || chr(13) || chr(10) || 'x' || split_part(text, '.', 2) || chr(13) || '>' || source || chr(10) || text AS body FROM documents",
    f"SELECT doc_id, md5(left(trim(replace(a || chr(10) || 'x' || b || chr(10) || text, chr(13), chr(10)), {_BLANKS}), 8000)) AS own FROM g",
)
def bodies_unquoted(g: DataFrame) -> DataFrame:
    return g.select("doc_id", F.md5(cleaning.unquoted(F.col("body"))).alias("own"))


_NOISY = "(" + _any("lower(url) LIKE '%{}'", cleaning.IMAGE_ENDINGS) + " OR " + _any("contains(lower(url), '{}')", cleaning.NOISY_LINKS) + ")"


@_R.over(
    "SELECT page_id, url, 'Read ' || url || '. Or ' || url || '/unsubscribe and https://i.example/p.PNG, then (' || url || '); ' || CASE WHEN page_id % 2 = 0 THEN 'https://next.example/' || cast(page_id AS varchar(20)) || '> ' ELSE '' END || 'https://last.example/x' AS body FROM pages",
    f"SELECT page_id, CASE WHEN {_NOISY} THEN '' ELSE url || ' ' END || CASE WHEN page_id % 2 = 0 THEN 'https://next.example/' || page_id ELSE 'https://last.example/x' END || CASE WHEN {_NOISY} AND page_id % 2 = 0 THEN ' https://last.example/x' ELSE '' END AS links FROM g",
)
def links_primary(g: DataFrame) -> DataFrame:
    return g.select("page_id", _joined(cleaning.primary_links(F.col("body"))).alias("links"))


_PARTS = "SELECT cast(floor(page_id / 4) AS bigint) AS mail, 'file' || cast(page_id AS varchar(20)) AS name, substr(html, 1, cast(page_id * 137 % 1500 AS int)) AS text FROM pages"


@_R.over(
    _PARTS,
    "",
)
def attachments_packed(g: DataFrame) -> DataFrame:
    """Names and texts of each message's attachments within its budget, largest first."""
    own = g.groupBy("mail").agg(F.collect_list(F.struct("name", "text")).alias("parts"))
    return own.select("mail", F.md5(cleaning.packed_attachments(F.col("parts"), (F.lit(150) + F.col("mail") % 7 * 400).cast("int"))).alias("packed"))


# the fold over each message's parts, longest first
ORACLE_SQL["attachments_packed"] = f"""WITH RECURSIVE g AS ({_PARTS}),
usable AS (SELECT mail, name, text, row_number() OVER (PARTITION BY mail ORDER BY length(text) DESC, name) AS k, count(*) OVER (PARTITION BY mail) AS n FROM g WHERE trim(text, {_BLANKS}) <> ''),
mails AS (SELECT mail, 150 + mail % 7 * 400 AS budget, coalesce(max(n), 0) AS n FROM (SELECT DISTINCT mail FROM g) LEFT JOIN usable USING (mail) GROUP BY mail),
fold AS (
  SELECT mail, n, 0 AS k, budget - 30 * n AS room, n AS many, '' AS packed FROM mails
  UNION ALL SELECT f.mail, f.n, f.k + 1, CASE WHEN take >= 80 THEN room - take ELSE room END, many - 1, packed || CASE WHEN take >= 80 THEN chr(10) || chr(10) || '[Attachment: ' || name || ']' || chr(10) || left(text, take) ELSE '' END
  FROM (SELECT fold.*, name, text, least(room // greatest(many, 1), length(text)) AS take FROM fold JOIN usable u ON u.mail = fold.mail AND u.k = fold.k + 1) f)
SELECT mail, md5(CASE WHEN budget <= 200 OR budget - 30 * fold.n <= 200 THEN '' ELSE packed END) AS packed FROM fold JOIN mails USING (mail) WHERE k = fold.n"""


@_R.over(
    """SELECT conv_id, turn, text, CASE (conv_id + turn) % 6 WHEN 0 THEN 'Summary: ' || text WHEN 1 THEN '"' || text || '"' WHEN 2 THEN 'thought' || chr(10) || 'Thinking Process: 1.' || chr(10) || '(This is the response.) ' || text WHEN 3 THEN 'Thinking process: only'
      WHEN 4 THEN ' tl;dr: "x" ' || text ELSE text END AS reply FROM conversations""",
    f"SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 3 THEN '' WHEN 4 THEN trim('\"x\" ' || text, {_BLANKS}) ELSE trim(text, {_BLANKS}) END AS clean FROM g",
)
def replies_cleaned(g: DataFrame) -> DataFrame:
    return g.select("conv_id", "turn", cleaning.cleaned_reply(F.col("reply")).alias("clean"))


@_R.over(
    "SELECT page_id, url, 'see [a ' || cast(page_id AS varchar(20)) || '](' || url || CASE page_id % 3 WHEN 0 THEN '] now' WHEN 1 THEN '' ELSE ') and [b](https://b.example/x' END AS text FROM pages",
    "SELECT page_id, 'see [a ' || page_id || '](' || url || ')' || CASE page_id % 3 WHEN 0 THEN ' now' WHEN 1 THEN '' ELSE ' and [b](https://b.example/x)' END AS fixed FROM g",
)
def links_repaired(g: DataFrame) -> DataFrame:
    return g.select("page_id", cleaning.repaired_links(F.col("text")).alias("fixed"))


@_R.over(
    "SELECT doc_id, text, CASE WHEN doc_id % 5 = 4 THEN 'no facts' ELSE '' END AS broken FROM documents",
    f"SELECT doc_id, md5(CASE WHEN broken <> '' THEN '' ELSE array_to_string(list_filter(list_transform(string_split(text, '.'), lambda x: trim(x, {_BLANKS})), lambda x: x <> ''), '|') END) AS facts FROM g",
)
def facts_parsed(g: DataFrame) -> DataFrame:
    """Facts in a model's replies: the sentences of every document as JSON, in a fence, inside talk, beside other values, or none."""
    told = F.to_json(F.struct(F.split("text", r"\.").alias("facts")))
    fenced, inside = F.concat(F.lit("```json\n"), told, F.lit("\n```")), F.concat(F.lit("Sure: "), told, F.lit(" done"))
    mixed = F.concat(F.lit('{"other": {"a": 1}, '), F.substring(told, F.lit(2), F.length(told) - 3), F.lit(', 7, null, " ", ["x"]]}'))
    reply = F.element_at(F.array(told, fenced, inside, mixed, F.lit('{"facts": "none"}')), (F.col("doc_id") % 5 + 1).cast("int"))
    return g.select("doc_id", F.md5(F.array_join(cleaning.facts_of(reply), "|")).alias("facts"))


@_R.over(
    "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN ' ' || source || ' Dept. ' WHEN 1 THEN 'from:' || source || '@x.com' WHEN 2 THEN split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) || ' B&' || source WHEN 3 THEN 'a b c d ' || source WHEN 4 THEN substr(text, 1, 41) ELSE source || '-' || lang END AS phrase FROM documents",
    "SELECT doc_id, CASE WHEN regexp_full_match(lower(trim(phrase)), '[a-z0-9][a-z0-9 &''.-]*') AND length(trim(phrase)) <= 40 AND len(regexp_extract_all(trim(phrase), '[^ ]+')) <= 4 THEN lower(trim(phrase)) END AS safe FROM g",
)
def expansions_safe(g: DataFrame) -> DataFrame:
    return g.select("doc_id", cleaning.safe_expansion(F.col("phrase")).alias("safe"))


@_R.over(
    "SELECT doc_id, cast(floor(doc_id / 20) AS bigint) AS page, quality + 2 * toxic AS grade FROM labels",
    "SELECT page, 'd' || doc_id AS id, grade FROM g",
)
def grades_parsed(g: DataFrame) -> DataFrame:
    """Grades in replies of lines ``id grade``: one for each page of labelled documents, with bad lines and an earlier grade of each id."""
    line = F.concat(F.lit("d"), "doc_id", F.lit(" "), "grade")
    own = g.groupBy("page").agg(F.array_join(F.array_sort(F.collect_list(F.concat(line, F.lit(" sure"))), ), "\n").alias("good"), F.array_join(F.transform(F.collect_list("doc_id"), lambda d: F.concat(F.lit("d"), d, F.lit(" "), d % 9)), "\n").alias("early"))
    reply = F.concat("early", F.lit("\nd1 x\nd2\n\nd3 17\n  "), "good", F.lit("\nlast 4\n"))
    told = own.select("page", F.explode(cleaning.grades_of(reply)).alias("id", "grade"))
    return told.select("page", "id", F.col("grade").cast("long").alias("grade"))


@_R.over(
    "SELECT conv_id, turn, role, text FROM conversations",
    "SELECT conv_id, turn, 'find_' || role AS name, text AS q FROM g WHERE role <> 'system' UNION ALL SELECT conv_id, turn, '?', NULL FROM g WHERE role = 'assistant'",
)
def tool_uses(g: DataFrame) -> DataFrame:
    """Calls in event lines: users' turns make one, assistants' two (one without a name), system turns are broken lines."""
    called = lambda name: F.struct(F.lit("tool_use").alias("type"), name.alias("name"), F.struct(F.col("text").alias("q")).alias("input"))
    said = F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("name"), F.struct(F.col("text").alias("q")).alias("input"))
    nameless = F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("name"), F.struct(F.lit(None).cast("string").alias("q")).alias("input"))
    own = called(F.concat(F.lit("find_"), "role"))
    content = F.when(F.col("role") == "assistant", F.array(said, own, nameless)).otherwise(F.array(own, said))
    event = F.when(F.col("role") == "system", F.lit("{bad")).otherwise(F.to_json(F.struct(F.struct(content.alias("content")).alias("message"))))
    used = g.select("conv_id", "turn", F.explode(cleaning.tool_uses(event)).alias("u"))
    return used.select("conv_id", "turn", "u.name", F.get_json_object("u.args", "$.q").alias("q"))


@_R.over(
    "SELECT conv_id, turn, substr(md5(text), 1, 16) AS own, substr(md5(role), 1, 12) AS other, 'as [ref:' || substr(md5(text), 1, 6) || '] and ' || substr(md5(text), 1, 16) || ' or ' || substr(md5(role), 1, 12) || ' say [ref:zz] ' || text AS text FROM conversations",
    """SELECT conv_id, turn, ref, starts_with(own || 'ff', ref) OR starts_with('abc', ref) AS known FROM (SELECT conv_id, turn, own, unnest(list_distinct(list_concat(regexp_extract_all(text, '\\[ref:([^\\]\\s]+)\\]', 1),
      list_filter(regexp_split_to_array(regexp_replace(text, '\\[ref:[^\\]]*\\]', ' ', 'g'), '[^\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[0-9a-f]{8,20}'))))) AS ref FROM g)""",
)
def citations_checked(g: DataFrame) -> DataFrame:
    each = g.select("conv_id", "turn", F.explode(cleaning.citations(F.col("text"))).alias("ref"), F.array(F.concat("own", F.lit("ff")), F.lit("abc")).alias("refs"))
    return each.select("conv_id", "turn", "ref", F.exists("refs", lambda k: k.startswith(F.col("ref"))).alias("known"))
