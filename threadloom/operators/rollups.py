"""Views and rollups over messages, attachments, costs and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ids of a bucket of a running sum.
BUCKET = 4096


def latest_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order``; give an order without ties."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def thread_summary(messages: DataFrame) -> DataFrame:
    """Per tenant and thread: count, date range, first subject, senders in order of appearance, all senders, all labels.

    Subjects stay out of the lists; a label set is at most as large as there are labels.
    """
    rows = F.array_sort(F.collect_list(F.struct("date", "id", "from_addr")))
    grouped = messages.groupBy("user_id", "thread_id").agg(
        F.count(F.lit(1)).alias("message_count"),
        F.min("date").alias("date_first"),
        F.max("date").alias("date_last"),
        F.min_by("subject", F.struct("date", "id")).alias("subject"),
        F.transform(rows, lambda r: r["from_addr"]).alias("all_from_addrs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))).alias("all_labels"),
    )
    return grouped.select("user_id", "thread_id", "message_count", "date_first", "date_last", "subject", F.array_distinct("all_from_addrs").alias("participants"), "all_from_addrs", "all_labels")


def thread_summary_incremental(messages: DataFrame, touched: DataFrame) -> DataFrame:
    """Recompute only the touched threads: sorted distinct senders and labels, least subject at the earliest date."""
    own = messages.join(touched.select("user_id", "thread_id").distinct(), ["user_id", "thread_id"], "left_semi")
    return own.groupBy("user_id", "thread_id").agg(
        F.count(F.lit(1)).alias("message_count"),
        F.min("date").alias("date_first"),
        F.max("date").alias("date_last"),
        F.min_by("subject", F.struct("date", "subject")).alias("subject"),
        F.array_sort(F.collect_set("from_addr")).alias("participants"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))).alias("all_labels"),
    )


#: What a guarded write of a thread's summary compares.
SUMMARY_COLUMNS = ["message_count", "date_first", "date_last", "subject", "participants", "all_labels"]


def merge_changed(old: DataFrame, new: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """Rows of ``new`` that aren't in ``old`` or differ there in a compared column, null-safely."""
    before = old.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in compared], F.lit(True).alias("__there"))
    same = F.col("__there").isNotNull()
    for c in compared:
        same = same & F.col(c).eqNullSafe(F.col(f"__old_{c}"))
    return new.join(before, keys, "left").where(~same).select(new.columns)


def contact_frequency(messages: DataFrame) -> DataFrame:
    """Per tenant and address: the least count of its spellings (as repeated upserts leave it) and ln(c+1)/ln(max+1)."""
    raw = messages.groupBy("user_id", "from_addr").agg(F.count(F.lit(1)).alias("n"))
    top = raw.groupBy("user_id").agg(F.max("n").alias("top"))
    return (
        raw.withColumn("email", email_of(F.col("from_addr")))
        .groupBy("user_id", "email")
        .agg(F.min("n").alias("message_count"))
        .join(top, "user_id")
        .select("user_id", "email", "message_count", F.round(F.log(F.col("message_count") + 1) / F.log(F.col("top") + 1), 6).alias("score"))
    )


def email_of(address: Column) -> Column:
    """The address in angle brackets, or the whole, in lower case."""
    inner = F.regexp_extract(address, "<([^>]*)", 1)
    return F.lower(F.trim(F.when(address.contains("<"), inner).otherwise(address)))


def inbox(messages: DataFrame, user: str, limit: int = 50) -> DataFrame:
    """Latest message of each thread that has one in the inbox, newest first, with the thread's size."""
    threads = messages.where(F.col("user_id") == user).groupBy("thread_id").agg(
        F.bool_or(F.array_contains("labels", "INBOX")).alias("inside"), F.count(F.lit(1)).alias("message_count"), F.max(F.struct("date", "id", "subject", "from_addr")).alias("last")
    )
    found = threads.where("inside").orderBy(F.desc("last.date"), F.desc("thread_id")).limit(limit)
    return found.select("thread_id", "last.id", "last.subject", "last.from_addr", "last.date", "message_count")


def priority_section(messages: DataFrame, user: str, section: str) -> DataFrame:
    """Threads of a priority section: important_unread, starred, or everything_else (which leaves out threads of the others)."""
    has = lambda x: F.array_contains("labels", x)
    flags = messages.where(F.col("user_id") == user).groupBy("thread_id").agg(
        F.bool_or(has("IMPORTANT") & has("UNREAD") & has("INBOX")).alias("important_unread"),
        F.bool_or(has("STARRED")).alias("starred"),
        F.bool_or(has("INBOX")).alias("inside"),
        F.max("date").alias("date_last"),
    )
    other = F.col("inside") & ~F.col("important_unread") & ~F.col("starred")
    wanted = {"important_unread": F.col("important_unread"), "starred": F.col("starred") & ~F.col("important_unread"), "everything_else": other}[section]
    return flags.where(wanted).select("thread_id", "date_last")


def battle_leaderboard(battles: DataFrame) -> DataFrame:
    """Wins, losses, ties and both-bad votes of each variant, each battle counted for both sides."""
    sides = battles.select("winner", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("variant_a").alias("variant")), F.struct(F.lit("b").alias("side"), F.col("variant_b").alias("variant")))).alias("s")).select("winner", "s.*")
    won, lost = F.col("winner") == F.col("side"), F.col("winner").isin("a", "b") & (F.col("winner") != F.col("side"))
    out = sides.groupBy("variant").agg(
        F.count_if(won).alias("wins"), F.count_if(lost).alias("losses"), F.count_if(F.col("winner") == "tie").alias("ties"), F.count_if(F.col("winner") == "both_bad").alias("both_bad"), F.count(F.lit(1)).alias("total")
    )
    return out.withColumn("win_rate", F.round(F.col("wins") / F.col("total"), 6))


def crawl_lanes(attachments: DataFrame, dead: int = 10) -> DataFrame:
    """URL stubs by crawl state."""
    pending = F.col("extracted_text").isNull()
    tries = F.col("crawl_attempts")
    return attachments.groupBy("user_id").agg(
        F.count_if(pending & (tries == 0)).alias("fast"), F.count_if(pending & (tries > 0) & (tries < dead)).alias("slow"), F.count_if(pending & (tries >= dead)).alias("dead"), F.count_if(~pending).alias("done")
    )


def backoff_due(queue: DataFrame, attempts: str, last: str, now: Column, most: int, base_hours: float = 1.0, less: int = 1) -> DataFrame:
    """Rows that may be tried again: never tried, or ``base * 2 ** (attempts - less)`` hours after the last try, below ``most`` tries."""
    wait = F.pow(F.lit(2.0), F.col(attempts) - less) * base_hours * 3600
    return queue.where((F.col(attempts) < most) & ((F.col(attempts) == 0) | (F.unix_timestamp(now) - F.unix_timestamp(F.col(last)) >= wait)))


def running_budget(costs: DataFrame, limit: float) -> DataFrame:
    """Per tenant, the rows in order of id whose running cost stays within ``limit``.

    Ids go into buckets; a bucket's start is the sum of those before it, so a tenant of
    any size is summed in many tasks.
    """
    bucket = F.floor(F.col("id") / BUCKET)
    sums = costs.groupBy("user_id", bucket.alias("__bucket")).agg(F.sum("estimated_cost_usd").alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(W.partitionBy("user_id").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    starts = sums.select("user_id", "__bucket", before.alias("__before"))
    inside = F.sum("estimated_cost_usd").over(W.partitionBy("user_id", "__bucket").orderBy("id").rowsBetween(W.unboundedPreceding, 0))
    return costs.withColumn("__bucket", bucket).join(starts, ["user_id", "__bucket"]).withColumn("spent", F.col("__before") + inside).where(F.col("spent") <= limit).drop("__bucket", "__before")
