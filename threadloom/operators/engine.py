"""One search over all steps: candidates, words and meaning, signals of threads, their blend, and what of it is shown.

``search`` takes what a user typed and the tables one tenant may see.  Everything is
declared as one plan but for the index's totals and the trigger of the second ranking.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import cleaning
from threadloom.operators import logs, rollups, search
from threadloom.sources.word_index import WordIndex


@dataclass
class Mailbox:
    """What a tenant's search reads: messages (with ``labels``), vectors (message_id, embedding), and the index of the messages."""

    messages: DataFrame
    vectors: DataFrame
    index: WordIndex


@dataclass
class Question:
    """What is asked for: text and its vector, words that stand for others, and where to look (``candidates``: ids, or all)."""

    text: str
    vector: list[float]
    aliases: dict[str, list[str]] = field(default_factory=dict)
    candidates: DataFrame | None = None
    as_of: str = "1970-01-01T00:00:00Z"


def word_scores(index: WordIndex, question: Question) -> DataFrame:
    """(id, bm25): the better of two passes, with the words' aliases and without, each scaled to 0..1 by itself."""
    plain = cleaning.search_tokens(question.text)
    wide = cleaning.search_tokens(cleaning.expanded(question.text, question.aliases))
    passes = [list(dict.fromkeys(t.lower() for t in p)) for p in ([wide] if wide == plain else [wide, plain])]
    scored = None
    for terms in passes:
        found = index.bm25(terms)
        if question.candidates is not None:
            found = found.join(question.candidates.select("id"), "id", "left_semi")
        own = search.min_max(found, "score", 1.0)
        scored = own if scored is None else scored.union(own)
    return scored.groupBy("id").agg(F.max("score").alias("bm25"))


def matches(box: Mailbox, question: Question) -> DataFrame:
    """(id, sim, bm25) of every message a search finds, by its best chunk and its words."""
    near = box.vectors.select(F.col("message_id").alias("id"), "embedding")
    if question.candidates is not None:
        near = near.join(question.candidates.select("id"), "id", "left_semi")
    best = near.groupBy("id").agg(F.max(F.round(search.dot(F.col("embedding"), question.vector), 6)).alias("sim"))
    return word_scores(box.index, question).join(search.min_max(best, "sim", 0.0), "id", "full")


def threads(box: Mailbox, question: Question) -> DataFrame:
    """Each thread with a match, with all signals the blend reads."""
    own = box.messages
    hits = matches(box, question).join(own.select("id", "thread_id"), "id")
    matched = hits.groupBy("thread_id").agg(F.coalesce(F.max("sim"), F.lit(0.0)).alias("sim"), F.coalesce(F.max("bm25"), F.lit(0.0)).alias("bm25"), F.count(F.lit(1)).alias("matched"))
    contacts = rollups.contact_frequency(own).select("email", F.col("score").alias("contact"))
    owner = own.groupBy("from_addr").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "from_addr").limit(1).select("from_addr", F.lit(True).alias("is_owner"))
    senders = own.withColumn("email", rollups.email_of(F.col("from_addr"))).join(contacts, "email", "left").join(F.broadcast(owner), "from_addr", "left")
    people = senders.groupBy("thread_id").agg(F.coalesce(F.max("contact"), F.lit(0.0)).alias("contact"), F.coalesce(F.bool_or("is_owner"), F.lit(False)).alias("replied"))
    return matched.join(rollups.thread_summary(own), "thread_id").join(people, "thread_id")


def blended(box: Mailbox, question: Question) -> DataFrame:
    """``threads`` with their score: a question for recent mail moves weight to recency."""
    return search.blend(threads(box, question), question.as_of, question.text, cleaning.temporal_boost(question.text))


def ranked(box: Mailbox, question: Question, top: int = 20, rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(thread_id, score, place) of what is shown.

    Repeated notices of one sender are shown once, threads far below the best not at all; of twice
    ``top`` threads that are left the best ``top`` are shown.  If the first five lie
    close together, ``rerank`` (threads to (thread_id, place)) orders them anew; what it
    leaves out follows in the old order.
    """
    scored = blended(box, question).withColumn("score", F.round("score", 6)).withColumn("sender", F.get("participants", F.lit(0)))
    once = search.collapse_repeats(scored, "sender", "subject", "score", "message_count", "thread_id").select("thread_id", "score", "subject", "date_last")
    first = _held(once.orderBy(F.desc("score"), "thread_id").limit(2 * top))
    kept = _held(search.drop_off_topic(first, "score", "thread_id").orderBy(F.desc("score"), "thread_id").limit(top))
    if rerank is not None and logs.needs_rerank(kept).first()["rerank"]:
        kept = kept.join(rerank(kept).select("thread_id", F.col("place").alias("again")), "thread_id", "left")
    else:
        kept = kept.withColumn("again", F.lit(None).cast("long"))
    shown = F.array_sort(F.collect_list(F.struct(F.col("again").isNull().alias("rest"), "again", (-F.col("score")).alias("less"), "thread_id", "score")))
    # at most ``top`` rows
    return kept.agg(shown.alias("rows")).select(F.posexplode("rows").alias("place", "row")).select("row.thread_id", "row.score", (F.col("place") + 1).cast("long").alias("place"))


def _held(few: DataFrame) -> DataFrame:
    """A table of at most a page of rows as the driver's own, so that what made it runs once."""
    return few.sparkSession.createDataFrame(few.collect(), few.schema)
