"""Retrieval and ranking as DataFrames: vector top-k, BM25, rank fusion and the thread blend."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.sources.word_index import WordIndex

K1, B = 1.2, 0.75
MESSAGE_FIELDS, ATTACHMENT_FIELDS = ("subject", "from_addr", "to_addr", "body_text"), ("filename", "extracted_text")
# fixed values: the blend's weights and the label scores
WEIGHTS = {"sim": 0.40, "bm25": 0.15, "recency": 0.15, "labels": 0.12, "replied": 0.08, "density": 0.06, "tsize": 0.04, "contact": 0.08, "fresh": 0.18}
LABEL_SCORES = {"IMPORTANT": 0.35, "CATEGORY_PERSONAL": 0.25, "CATEGORY_UPDATES": 0.10, "CATEGORY_SOCIAL": 0.0, "CATEGORY_PROMOTIONS": -0.15, "SENT": 0.15, "INBOX": 0.10, "STARRED": 0.30}


def dot(vector: Column, query: list[float]) -> Column:
    """Inner product with a constant vector, in double precision, without Python."""
    return F.aggregate(F.zip_with(vector, F.array(*map(F.lit, query)), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def length(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def cosine(vector: Column, query: list[float]) -> Column:
    return dot(vector, query) / length(vector) / float(sum(x * x for x in query)) ** 0.5


def shortened(vector: Column, dims: int) -> Column:
    """The first ``dims`` components, at unit length."""
    head = F.slice(vector, 1, dims)
    return F.transform(head, lambda x: x.cast("double") / length(head))


def coherence(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, vectors, coherence): mean cosine of each group's vectors to their centroid.

    Centroids are added up by component, so a group's vectors never meet in one place.
    """
    own = vectors.select(group, vector)
    parts = own.select(group, F.posexplode(vector).alias("at", "x")).groupBy(group, "at").agg(F.avg(F.col("x").cast("double")).alias("c"))
    centroid = parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "c"))), lambda p: p["c"]).alias("c"))
    product = F.aggregate(F.zip_with(vector, "c", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return own.join(centroid, group).groupBy(group).agg(F.count(F.lit(1)).alias("vectors"), F.round(F.avg(product / length(F.col(vector)) / length(F.col("c"))), 6).alias("coherence"))


def vector_topk(embeddings: DataFrame, query: list[float], k: int, id: str = "id") -> DataFrame:
    """The ``k`` nearest by inner product; partial and final top-k without a full sort."""
    return embeddings.select(id, F.round(dot(F.col("embedding"), query), 6).alias("score")).orderBy(F.desc("score"), id).limit(k)


def funnel_topk(embeddings: DataFrame, query: list[float], k: int, pool: int, dims: int, id: str = "id") -> DataFrame:
    """A pool by the first ``dims`` components, then the exact product over the pool."""
    near = embeddings.withColumn("__short", dot(F.slice("embedding", 1, dims), query[:dims])).orderBy(F.desc("__short"), id).limit(pool)
    return vector_topk(near, query, k, id)


def hash_sample(rows: DataFrame, id: str, limit: int) -> DataFrame:
    """About ``limit`` rows by a multiplicative hash of an integer id that any engine computes alike: every k-th of them, k = ceil(rows / limit)."""
    every = max(1, -(-rows.count() // limit))
    return rows.where(F.expr(f"(pmod({id} * 2654435761, 4294967296) DIV 65536) % {every} = 0"))


def prefix_lookup(rows: DataFrame, column: str, prefix: str, most: int = 5) -> DataFrame:
    """(outcome, found) of ids that begin with a prefix: one, many (the first ``most``), none, or invalid (no hexadecimal text of 4 to 20)."""
    import re

    fine = re.fullmatch(r"[0-9a-f]{4,20}", prefix) is not None
    first = rows.where(F.col(column).startswith(prefix) if fine else F.lit(False)).select(column).distinct().orderBy(column).limit(most)
    found = first.agg(F.array_sort(F.collect_list(column)).alias("found"))
    outcome = F.when(F.lit(not fine), "invalid").when(F.size("found") == 0, "none").when(F.size("found") == 1, "one").otherwise("many")
    return found.select(F.lit(prefix).alias("prefix"), outcome.alias("outcome"), F.array_join("found", " ").alias("found"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def _counted(docs: DataFrame, id: str, fields: list[Column], terms: list[str]) -> DataFrame:
    """(id, dl, t0.., phrase of field 0, ..of field 1, ..): lengths, counts of terms and of all of them in a row.

    Each text is cut into words once; the exchange lets the sums over all rows and the
    scores read the same small rows.
    """
    split = docs.select(F.col(id).alias("id"), *(tokens(F.coalesce(f, F.lit(""))).alias(f"w{k}") for k, f in enumerate(fields)))
    # two spaces between words, so that a phrase may follow on itself
    row = lambda w: F.concat(F.lit(" "), F.array_join(w, "  "), F.lit(" "))
    phrase = lambda w: F.size(F.split(row(w), f"\\Q {'  '.join(terms)} \\E", -1)) - 1 if len(terms) > 1 else F.lit(0)
    near = split.select("id", *(x for k in range(len(fields)) for x in (F.size(f"w{k}").alias(f"dl{k}"), F.filter(f"w{k}", lambda w: w.isin(*terms)).alias(f"h{k}"), phrase(F.col(f"w{k}")).alias(f"ph{k}"))))
    times = lambda k, t: F.size(F.filter(f"h{k}", lambda w: w == t))
    return near.select("id", *(x for k in range(len(fields)) for x in (f"dl{k}", f"ph{k}", *(times(k, t).alias(f"t{k}_{i}") for i, t in enumerate(terms))))).repartition("id")


def _scored(counted: DataFrame, fields: int, terms: int) -> DataFrame:
    """(id, any, phrase): textbook BM25 summed over fields, of the terms and of their phrase."""
    sums = counted.agg(F.count(F.lit(1)).alias("n"), *(x for k in range(fields) for x in (F.avg(f"dl{k}").alias(f"avg{k}"), *(F.count_if(F.col(f"t{k}_{i}") > 0).alias(f"d{k}_{i}") for i in range(terms)))))
    idf = lambda k, i: F.log(1 + (F.col("n") - F.col(f"d{k}_{i}") + 0.5) / (F.col(f"d{k}_{i}") + 0.5))

    def part(k: int, tf: str) -> Column:
        return F.when(F.col(tf) > 0, F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(f"dl{k}") / F.col(f"avg{k}")))).otherwise(F.lit(0.0))

    words = reduce(add, (idf(k, i) * part(k, f"t{k}_{i}") for k in range(fields) for i in range(terms)))
    phrase = reduce(add, (reduce(add, (idf(k, i) for i in range(terms))) * part(k, f"ph{k}") for k in range(fields)))
    # the sums are one row; a document without a term scores 0, which only shows here, behind the shared exchange
    return counted.join(F.broadcast(sums)).select("id", words.alias("any"), phrase.alias("phrase")).where("any > 0")


def bm25(docs: DataFrame, terms: list[str], id: str, text: str) -> DataFrame:
    """Textbook BM25 of each document that has a term."""
    return _scored(_counted(docs, id, [F.col(text)], terms), 1, len(terms)).select("id", F.round("any", 6).alias("score"))


def text_search(messages: WordIndex, attachments: WordIndex, owners: DataFrame, terms: list[str], phrase_weight: float = 1.5) -> DataFrame:
    """(id, score) of messages with a term in any field of theirs or of their attachments (``owners``: id, message_id).

    A message's score is the best of its own and its attachments', each by its words or,
    weighted, by the phrase they make, scaled to 0..1 over all that match.
    """
    best = F.greatest(F.col("any"), phrase_weight * F.col("phrase")).alias("score")
    held = owners.select("id", "message_id").join(attachments.scores(terms).where("any > 0").select("id", best), "id").select(F.col("message_id").alias("id"), "score")
    found = messages.scores(terms).where("any > 0").select("id", best).union(held).groupBy("id").agg(F.max("score").alias("score"))
    return min_max(found, "score", 1.0).withColumn("score", F.round("score", 6))


def min_max(df: DataFrame, column: str, equal: float) -> DataFrame:
    """``column`` scaled to 0..1 over all rows; ``equal`` if all are the same."""
    ends = df.agg(F.min(column).alias("__low"), F.max(column).alias("__high"))
    scaled = F.when(F.col("__high") > F.col("__low"), (F.col(column) - F.col("__low")) / (F.col("__high") - F.col("__low"))).otherwise(F.lit(equal))
    return df.join(F.broadcast(ends)).withColumn(column, scaled).drop("__low", "__high")


def fuse(first: DataFrame, second: DataFrame, k: int = 60, id: str = "id") -> DataFrame:
    """Reciprocal rank fusion of two tables (id, rank)."""
    part = lambda c: F.coalesce(1 / (k + F.col(c)), F.lit(0.0))
    both = first.select(id, F.col("rank").alias("r1")).join(second.select(id, F.col("rank").alias("r2")), id, "full")
    return both.select(id, F.round(part("r1") + part("r2"), 9).alias("rrf"))


def recency(date: Column, as_of: str, half_life_days: float = 60.0) -> Column:
    """exp(-0.693 days / half life); the future counts as now, an unreadable date as never."""
    days = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.try_to_timestamp(date))) / 86400
    return F.coalesce(F.exp(-0.693 * F.greatest(days, F.lit(0.0)) / half_life_days), F.lit(0.0))


def label_score(labels: Column) -> Column:
    total = F.aggregate(labels, F.lit(0.0), lambda s, x: s + F.coalesce(F.create_map(*(F.lit(v) for kv in LABEL_SCORES.items() for v in kv))[x], F.lit(0.0)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def normalized_subject(subject: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(subject)), r"^(re|fwd|fw):\s*", ""), r"[0-9]+", "#")


def collapse_repeats(ranked: DataFrame, sender: str, subject: str, score: str, size: str, id: str, least: int = 3) -> DataFrame:
    """Of ``least`` or more single-message threads with the same sender and subject pattern, only the best stays."""
    group = W.partitionBy(sender, normalized_subject(F.col(subject)), F.col(size) == 1)
    nth, many = F.row_number().over(group.orderBy(F.desc(score), id)), F.count(F.lit(1)).over(group)
    return ranked.withColumn("__nth", nth).withColumn("__many", many).where((F.col(size) > 1) | (F.col("__many") < least) | (F.col("__nth") == 1)).drop("__nth", "__many")


def drop_off_topic(ranked: DataFrame, score: str, id: str, share: float = 0.4, least: int = 3) -> DataFrame:
    """Rows of at least ``share`` of the best score, or the ``least`` best if fewer pass."""
    best = ranked.agg(F.max(score).alias("__best"))
    marked = ranked.join(F.broadcast(best)).withColumn("__ok", (F.col("__best") <= 0) | (F.col(score) >= share * F.col("__best")))
    passed = marked.agg(F.count_if("__ok").alias("__passed"))
    first = ranked.orderBy(F.desc(score), id).limit(least).select(id, F.lit(True).alias("__first"))
    kept = marked.join(F.broadcast(passed)).join(F.broadcast(first), id, "left")
    return kept.where(F.when(F.col("__passed") >= least, F.col("__ok")).otherwise(F.col("__first").isNotNull() | F.col("__ok"))).select(ranked.columns)


def blend(threads: DataFrame, as_of: str, phrase: str, boost: float = 0.0) -> DataFrame:
    """``threads`` with ``score``; they carry sim, bm25, matched, message_count, date_last, subject, all_labels, contact and replied.

    ``boost`` moves weight from similarity to recency where a query asks for recent mail.
    A strong match that is also recent gets a bonus.
    """
    w, n = WEIGHTS, F.col("message_count")
    fresh = recency(F.col("date_last"), as_of)
    top = threads.agg(F.max("bm25").alias("__top"))  # one row
    share = F.when(F.col("__top") > 0, F.col("bm25") / F.col("__top")).otherwise(F.lit(0.0))
    exact = F.lower("subject").contains(phrase.strip().lower()) if phrase.strip() else F.lit(False)
    strength = F.greatest(F.col("sim"), share, F.when(exact, F.lit(1.0)).otherwise(F.lit(0.0)))
    score = (
        (w["sim"] - boost) * F.col("sim")
        + w["bm25"] * F.col("bm25")
        + (w["recency"] + boost) * fresh
        + w["labels"] * label_score(F.col("all_labels"))
        + F.when(F.col("replied"), F.lit(w["replied"])).otherwise(F.lit(0.0))
        + w["density"] * F.least(F.col("matched") / n, F.lit(1.0))
        + w["tsize"] * F.when(n > 1, F.least(F.log(n) / F.log(F.lit(50.0)), F.lit(1.0))).otherwise(F.lit(0.0))
        + w["contact"] * F.col("contact")
        + w["fresh"] * strength * fresh
    )
    return threads.join(F.broadcast(top)).withColumn("score", score).drop("__top")
