"""Queries for aliases, spelling, topics and vectors, with the DuckDB SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import aliases, topics
from threadloom.plans.mail_queries import _DOT, QUERY_VECTOR
from threadloom.plans.registry import Registry
from threadloom.sources.mail import table

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.oracle

# documents hold few words in capitals, so some words of each are raised; engines differ in word borders beside other letters than ASCII's, so there are none
_TEXT = "regexp_replace(regexp_replace(regexp_replace(text, '[^ -~]', 'x', 'g'), '\\b(the|and|les|der)\\b', upper('abc'), 'g'), '\\b(of|to|de|in)\\b', 'XYZ', 'g')"


def _text() -> Column:
    raised = F.regexp_replace(F.regexp_replace("text", "[^ -~]", "x"), r"\b(the|and|les|der)\b", "ABC")
    return F.regexp_replace(raised, r"\b(of|to|de|in)\b", "XYZ")


_TERMS = f"""t AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(x, '\\b[A-Z]{{2,5}}\\b'), lambda w: lower(w))) AS a, regexp_extract_all(lower(x), '[a-z]{{2,}}') AS w FROM (SELECT doc_id, {_TEXT} AS x FROM documents)),
    l AS (SELECT doc_id, a, list_filter(list_distinct(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))), lambda x: length(x) > 5) AS l FROM t),
    s AS (SELECT term, count(*) AS n FROM (SELECT unnest(a) AS term FROM l) GROUP BY 1), e AS (SELECT expansion, count(*) AS n FROM (SELECT unnest(l) AS expansion FROM l) GROUP BY 1),
    b AS (SELECT term, expansion, count(*) AS n FROM (SELECT term, unnest(l) AS expansion FROM (SELECT unnest(a) AS term, l FROM l)) WHERE NOT contains(expansion, term) GROUP BY 1, 2)"""
_FOUND = """SELECT term, expansion, n, round(jaccard, 6)::DOUBLE AS jaccard, nth FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY place) AS nth FROM (SELECT p.term, p.expansion, p.n, place, p.n / (s.n + e.n - p.n) AS jaccard
    FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY n DESC, expansion) AS place FROM b WHERE n >= 5 AND term IN (SELECT term FROM s WHERE n >= 3)) p JOIN s ON s.term = p.term JOIN e ON e.expansion = p.expansion WHERE place <= 20)
    WHERE jaccard >= 0.02) WHERE nth <= 3"""


@_R.query(f"WITH {_TERMS} {_FOUND}")
def aliases_discovered(spark: SparkSession, sf: str) -> DataFrame:
    """Companions of abbreviations; the texts' words are invented, so little overlap is asked for."""
    return aliases.discover(aliases.counts(table(spark, sf, "documents"), _text()), least_jaccard=0.02)


@_R.query(f"WITH {_TERMS} {_FOUND}")
def aliases_from_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The same from three runs of counts added up, as batches leave them."""
    d = table(spark, sf, "documents")
    runs = [aliases.counts(d.where(F.col("doc_id") % 3 == k), _text()) for k in range(3)]
    return aliases.discover(aliases.added(runs, "abbreviations", "expansion"), least_jaccard=0.02)


@_R.query(
    f"""WITH w AS (SELECT DISTINCT doc_id, lower(x) AS term, x = upper(x) AS caps FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(substr(text, 1, 0), '') || chr(10) || {_TEXT}, '[A-Za-z]{{2,5}}\\b')) AS x FROM documents))
    SELECT f.term, caps_df, other_df, contexts FROM (SELECT term, caps_df, other_df FROM (SELECT term, count(*) FILTER (WHERE caps) AS caps_df, count(*) FILTER (WHERE NOT caps) AS other_df FROM w GROUP BY term) WHERE caps_df >= 5 AND caps_df / (caps_df + other_df) >= 0.7 ORDER BY caps_df DESC, term LIMIT 4000) f
    JOIN (SELECT term, array_to_string(list(doc_id ORDER BY doc_id)[1:3], ' ') AS contexts FROM w WHERE caps GROUP BY term) USING (term)"""
)
def caps_vocabulary_gated(spark: SparkSession, sf: str) -> DataFrame:
    """Words mostly in capitals with the documents their first passages are from; each passage holds its word."""
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("#"), F.col("doc_id"), F.lit("#")).alias("subject"), _text().alias("body"))
    got = aliases.caps_vocabulary(d, "doc_id", "subject", "body")
    source = F.transform("contexts", lambda c: F.when(c.rlike("…") & F.contains(c, F.upper("term")), F.regexp_extract(c, "#([0-9]+)#", 1)).otherwise("missing"))
    return got.select("term", "caps_df", "other_df", F.array_join(source, " ").alias("contexts"))


@_R.query(
    """SELECT word, sum(n)::BIGINT AS n FROM (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(subject || ' ' || body_text), '[a-z]+')) AS word FROM messages) WHERE length(word) >= 2 GROUP BY 1
      UNION ALL SELECT word, count(*) * 50 FROM (SELECT unnest(regexp_extract_all(lower(trim(split_part(f, '<', 1))), '[a-z]{2,}')) AS word FROM (SELECT DISTINCT from_addr AS f FROM messages)) GROUP BY 1)
    GROUP BY word HAVING sum(n) >= 20 AND length(word) <= 24""",
    "messages",
)
def spell_dictionary_lifted(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "messages")
    words = m.select(F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" ", "subject", "body_text")), F.lit("[a-z]{2,}"), F.lit(0))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    names = m.select("from_addr").distinct().select(F.trim(F.split_part("from_addr", F.lit("<"), F.lit(1))).alias("name"))
    return aliases.spell_dictionary(words, names)


@_R.query("SELECT source, value, n, nth FROM (SELECT source, lang AS value, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS nth FROM documents GROUP BY source, lang) WHERE nth <= 2")
def top_values(spark: SparkSession, sf: str) -> DataFrame:
    return topics.top_per(table(spark, sf, "documents"), "source", F.col("lang"), 2)


@_R.query()
def topic_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Topics by repeated halving with their sizes; tests hold it against the rule."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    members = topics.assign(e, topics.fit(e))
    parent = F.regexp_extract("topic", r"^(.*)\.[01]$", 1)
    return members.groupBy("topic").agg(F.count(F.lit(1)).alias("messages")).withColumn("parent", F.when(parent != "", parent))


_LEAF = "SELECT id, 'root.' || CAST(id % 2 AS VARCHAR) || CASE WHEN id % 2 = 1 THEN '.' || CAST(id // 2 % 2 AS VARCHAR) ELSE '' END AS topic FROM (SELECT vec_id AS id FROM embeddings)"


@_R.query(f"SELECT topic, count(DISTINCT id // 4) AS threads FROM ({_LEAF}) GROUP BY topic")
def topic_facets(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    half = F.concat(F.lit("root."), (F.col("id") % 2).cast("string"))
    quarter = F.when(F.col("id") % 2 == 1, F.concat(half, F.lit("."), (F.floor(F.col("id") / 2) % 2).cast("string")))
    members = e.select("id", F.explode(F.array_compact(F.array(F.lit("root"), half, quarter))).alias("topic"))
    matches = e.select("id", F.floor(F.col("id") / 4).alias("thread_id"))
    return topics.facets(matches, members, topics.leaves(members))


_UNIT = "list_transform(embedding[1:16], lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding[1:16], lambda y: y::DOUBLE * y))))"


@_R.query(f"SELECT vec_id, round(list_sum(list_transform(list_zip({_UNIT}, {[float(x) for x in QUERY_VECTOR[:16]]}::DOUBLE[]), lambda x: x[1] * x[2])), 6) AS score FROM embeddings")
def vector_shortened(spark: SparkSession, sf: str) -> DataFrame:
    """The first 16 components at unit length against a query's."""
    from threadloom.operators.search import dot, shortened

    return table(spark, sf, "embeddings").select("vec_id", F.round(dot(shortened(F.col("embedding"), 16), QUERY_VECTOR[:16]), 6).alias("score"))


@_R.query(
    """WITH u AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS c FROM u GROUP BY label, i), n AS (SELECT label, sqrt(sum(c * c)) AS n FROM c GROUP BY label),
    s AS (SELECT u.label, u.vec_id, sum(x * c) / sqrt(sum(x * x)) / max(n) AS cosine FROM u JOIN c USING (label, i) JOIN n USING (label) GROUP BY u.label, u.vec_id) SELECT label, count(*) AS vectors, round(avg(cosine), 6) AS coherence FROM s GROUP BY label"""
)
def vector_coherence(spark: SparkSession, sf: str) -> DataFrame:
    """Mean cosine of each label's vectors to their centroid."""
    from threadloom.operators.search import coherence

    return coherence(table(spark, sf, "embeddings"), "label", "embedding")


@_R.query(f"SELECT vec_id FROM embeddings WHERE {_DOT.format(v='embedding')} / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) / sqrt(list_sum(list_transform({QUERY_VECTOR}::DOUBLE[], lambda x: x * x))) >= 0.1")
def vector_above_floor(spark: SparkSession, sf: str) -> DataFrame:
    from threadloom.operators.search import cosine

    return table(spark, sf, "embeddings").where(cosine(F.col("embedding"), QUERY_VECTOR) >= 0.1).select("vec_id")


@_R.query("SELECT vec_id AS id, 1::BIGINT AS leaves, true AS way FROM embeddings")
def topic_members(spark: SparkSession, sf: str) -> DataFrame:
    """Every message lies in one leaf of the tree and in all that lead to it."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    members = topics.assign(e, topics.fit(e))
    leaf = topics.leaves(members).withColumn("leaf", F.lit(True))
    own = members.join(F.broadcast(leaf), "topic", "left").groupBy("id").agg(F.count("leaf").alias("leaves"), F.count(F.lit(1)).alias("n"), F.max_by("topic", F.length("topic")).alias("last"))
    return own.select("id", "leaves", (F.col("n") == F.size(F.split("last", r"\."))).alias("way"))


@_R.query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS near_parts, round(quantile_cont(l_extendedprice, 0.5), 3) AS median, true AS near_median FROM lineitem GROUP BY l_returnflag")
def sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Exact counts and medians, and whether the sketches' stay within three times their stated error."""
    own = table(spark, sf, "lineitem")
    told = own.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.percentile_approx("l_extendedprice", F.lit(0.5), F.lit(1000)).alias("q"))
    parts = own.groupBy(F.col("l_returnflag").alias("flag"), "l_partkey").agg(F.count(F.lit(1)).alias("n")).groupBy("flag").agg(F.count("l_partkey").alias("parts"))
    # values with their counts, so that what a group's percentiles hold is built once
    prices = own.groupBy(F.col("l_returnflag").alias("flag"), "l_extendedprice").agg(F.count(F.lit(1)).alias("n"))
    exact = prices.groupBy("flag").agg(F.percentile("l_extendedprice", F.array(F.lit(0.497), F.lit(0.5), F.lit(0.503)), F.col("n")).alias("p"))
    for more in (parts, exact):
        told = told.join(more, F.col("l_returnflag").eqNullSafe(F.col("flag"))).drop("flag")
    low, median, high = (F.get("p", F.lit(k)) for k in range(3))
    return told.select("l_returnflag", "parts", (F.abs(F.col("a") / F.col("parts") - 1) <= 0.06).alias("near_parts"), F.round(median, 3).alias("median"), F.col("q").between(low, high).alias("near_median"))


@_R.query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) FILTER (WHERE l_linestatus = 'O') AS open_parts, true AS near_hll, true AS near_theta, true AS near_kll FROM lineitem GROUP BY l_returnflag")
def sketches_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches of parts merged: HyperLogLog and theta counts and a KLL median beside the exact values, within three times their stated errors."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    parts = l.groupBy("l_returnflag", "l_linestatus").agg(
        F.hll_sketch_agg("l_suppkey", F.lit(12)).alias("hll"), F.expr("theta_sketch_agg(CASE WHEN l_linestatus = 'O' THEN l_partkey END, 12)").alias("theta"), F.expr("kll_sketch_agg_double(l_quantity)").alias("kll")
    )
    merged = parts.groupBy("l_returnflag").agg(F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("h"), F.expr("theta_sketch_estimate(theta_union_agg(theta, 12))").alias("t"), F.expr("kll_sketch_get_quantile_double(kll_merge_agg_double(kll), 0.5D)").alias("k"))
    whole = l.groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct(F.when(F.col("l_linestatus") == "O", F.col("l_partkey"))).alias("open_parts"), F.percentile("l_quantity", F.lit(0.46)).alias("low"), F.percentile("l_quantity", F.lit(0.54)).alias("high"))
    near = lambda a, e: F.abs(F.col(a) - F.col(e)) <= 0.05 * F.col(e)
    return merged.join(whole, "l_returnflag").select("l_returnflag", "suppliers", "open_parts", near("h", "suppliers").alias("near_hll"), near("t", "open_parts").alias("near_theta"), F.col("k").between(F.col("low"), F.col("high")).alias("near_kll"))


@_R.query("SELECT source AS item, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, item LIMIT 3")
def sketch_top(spark: SparkSession, sf: str) -> DataFrame:
    """The commonest sources by a bounded counter, which is exact while there are fewer values than it tracks."""
    found = table(spark, sf, "documents").agg(F.expr("approx_top_k(source, 40, 10000)").alias("top"))
    return found.select(F.inline("top")).select("item", F.col("count").alias("n")).orderBy(F.desc("n"), "item").limit(3)
