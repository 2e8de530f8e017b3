"""Queries for facts, aliases, sender names, bulk mail, spelling and queue lanes, with the DuckDB SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.operators import spelling
from threadloom.sources.mail import table, with_views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


@query("SELECT id, trim(split_part(from_addr, '<', 1)) AS name, lower(rtrim(split_part(from_addr, '<', 2), '>')) AS email, split_part(rtrim(split_part(from_addr, '<', 2), '>'), '@', 2) AS domain FROM messages", "messages")
def sender_parts(spark: SparkSession, sf: str) -> DataFrame:
    address = F.regexp_extract("from_addr", "<([^>]*)>", 1)
    return table(spark, sf, "messages").select("id", F.trim(F.split_part("from_addr", F.lit("<"), F.lit(1))).alias("name"), F.lower(address).alias("email"), F.split_part(address, F.lit("@"), F.lit(2)).alias("domain"))


@query(
    """SELECT id, CASE WHEN list_contains(string_split(labels_csv, ','), 'CATEGORY_PROMOTIONS') THEN 'Promotional email from ' || trim(split_part(from_addr, '<', 1)) || '.' WHEN list_contains(string_split(labels_csv, ','), 'CATEGORY_SOCIAL') THEN 'Social notification from ' || trim(split_part(from_addr, '<', 1)) || '.' END AS summary FROM messages""",
    "messages",
)
def auto_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A canned text for bulk mail with who sent it, null for what needs a summary of its own."""
    name = F.trim(F.split_part("from_addr", F.lit("<"), F.lit(1)))
    sender = F.when(name != "", name).otherwise(F.split_part("from_addr", F.lit("@"), F.lit(1)))
    promoted, social = (F.array_contains("labels", x) for x in ("CATEGORY_PROMOTIONS", "CATEGORY_SOCIAL"))
    told = lambda what: F.concat(F.lit(f"{what} from "), sender, F.lit("."))
    return table(spark, sf, "messages").select("id", F.when(promoted, told("Promotional email")).when(social, told("Social notification")).alias("summary"))


@query("SELECT thread_id, count(DISTINCT l) AS labels, array_to_string(list_sort(list_distinct(list(l))), ' ') AS names FROM (SELECT thread_id, unnest(string_split(labels_csv, ',')) AS l FROM messages) WHERE l <> '' GROUP BY thread_id", "messages")
def label_union(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "messages").select("thread_id", F.explode("labels").alias("l")).distinct()
    return own.groupBy("thread_id").agg(F.count(F.lit(1)).alias("labels"), F.array_join(F.array_sort(F.collect_list("l")), " ").alias("names"))


_WORDS = "SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark"


@query(
    f"""WITH t AS ({_WORDS}), d AS (SELECT w, count(*) AS df FROM t GROUP BY w HAVING count(*) >= 2)
    SELECT x.w AS a, y.w AS b, count(*) AS both, round(count(*) / (p.df + q.df - count(*)), 6)::DOUBLE AS jaccard FROM t x JOIN t y ON x.item_id = y.item_id AND x.w < y.w JOIN d p ON p.w = x.w JOIN d q ON q.w = y.w
    GROUP BY x.w, y.w, p.df, q.df HAVING count(*) / (p.df + q.df - count(*)) >= 0.25"""
)
def alias_cooccurrence_all(spark: SparkSession, sf: str) -> DataFrame:
    """Words that appear together, however many texts have them."""
    return _cooccurring(table(spark, sf, "benchmark"))


def _cooccurring(texts: DataFrame, most: int | None = None) -> DataFrame:
    """Pairs of words of 2 to ``most`` texts (any number by default) with a Jaccard index of 0.25 or more.

    Such words are in at most four times as many texts as each other, so others of a text don't pair.
    """
    words = texts.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("w")).distinct()
    counts = words.groupBy("w").agg(F.count(F.lit(1)).alias("df")).where("df >= 2")
    seen = words.join(counts if most is None else counts.where(F.col("df") <= most), "w")
    a = seen.select("item_id", F.col("w").alias("a"), F.col("df").alias("a_df"))
    b = seen.select("item_id", F.col("w").alias("b"), F.col("df").alias("b_df"))
    near = (F.col("a") < F.col("b")) & (F.col("a_df") <= 4 * F.col("b_df")) & (F.col("b_df") <= 4 * F.col("a_df"))
    pairs = a.join(b, "item_id").where(near).groupBy("a", "b", "a_df", "b_df").agg(F.count(F.lit(1)).alias("both"))
    jaccard = F.col("both") / (F.col("a_df") + F.col("b_df") - F.col("both"))
    return pairs.where(jaccard >= 0.25).select("a", "b", "both", F.round(jaccard, 6).alias("jaccard"))


@query(
    """SELECT user_id, id, text FROM (SELECT p.*, row_number() OVER (PARTITION BY user_id ORDER BY length(text) DESC, id) AS nth FROM propositions p) WHERE nth <= 3""",
    "messages",
    "propositions",
)
def facts_longest_per_user(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "propositions").withColumn("nth", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc(F.length("text")), "id")))
    return p.where("nth <= 3").select("user_id", "id", "text")


@query("SELECT m.id FROM messages m WHERE NOT EXISTS (SELECT 1 FROM propositions p WHERE p.message_id = m.id) ORDER BY m.date DESC, m.id DESC LIMIT 500", "messages", "propositions")
def facts_pending(spark: SparkSession, sf: str) -> DataFrame:
    """The newest messages without facts: one batch of the extraction queue."""
    m = table(spark, sf, "messages").select("id", "date")
    done = table(spark, sf, "propositions").select(F.col("message_id").alias("id"))
    return m.join(done, "id", "left_anti").orderBy(F.desc("date"), F.desc("id")).limit(500).select("id")


@query(
    """WITH w AS (SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,24}')) AS w FROM documents) GROUP BY 1), d AS (SELECT * FROM w WHERE n >= 20)
    SELECT w.word, arg_min(d.word, (levenshtein(w.word, d.word), -d.n, d.word)) AS fixed, min(levenshtein(w.word, d.word))::INTEGER AS edits FROM w JOIN d ON abs(length(w.word) - length(d.word)) <= 2 AND levenshtein(w.word, d.word) <= 2 WHERE w.n < 20 GROUP BY w.word"""
)
def spell_correct(spark: SparkSession, sf: str) -> DataFrame:
    """Every rare word of the documents that is within two edits of a common one."""
    words = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,24}"), F.lit(0))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return spelling.corrected(words.where("n < 20"), words.where("n >= 20"))


@query("SELECT id, operation, round(sum(estimated_cost_usd) OVER (PARTITION BY user_id, operation ORDER BY timestamp, id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS last_ten FROM costs", "costs")
def cost_moving_sum(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("user_id", "operation").orderBy("timestamp", "id").rowsBetween(-9, 0)
    return table(spark, sf, "costs").select("id", "operation", F.round(F.sum("estimated_cost_usd").over(w), 6).alias("last_ten"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1), '(?s)<[^>]*>', ' ', 'g'), '[ \\n\\t\\r]+', ' ', 'g')) AS body FROM pages")
def main_content(spark: SparkSession, sf: str) -> DataFrame:
    """The text of a page's article."""
    inner = F.regexp_extract("html", r"(?s)<article[^>]*>(.*)</article>", 1)
    return table(spark, sf, "pages").select("page_id", F.trim(F.regexp_replace(F.regexp_replace(inner, r"(?s)<[^>]*>", " "), r"[ \n\t\r]+", " ")).alias("body"))


@query("SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')[1:12] AS words, length(text) > 80 AS cut FROM documents".replace("regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')[1:12] AS words", "array_to_string(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')[1:12], ' ') AS words"))
def snippet(spark: SparkSession, sf: str) -> DataFrame:
    """The first words of a text and whether it goes on."""
    words = F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), 1, 12)
    return table(spark, sf, "documents").select("doc_id", F.array_join(words, " ").alias("words"), (F.length("text") > 80).alias("cut"))
