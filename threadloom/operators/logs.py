"""Event logs, jobs and queues: folding, tailing, rates, stale jobs, triggers, outcomes and quality measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fold_calls(events: DataFrame, session: str = "session_id", seq: str = "seq", kind: str = "kind", name: str = "name", args: str = "args", rich: str = "call_full", streamed: str = "call") -> DataFrame:
    """Every rich call record, and of the streamed ones the first of each (name, arguments) that no rich one covers; rich first."""
    first = events.where(F.col(kind) == rich).withColumn("source", F.lit(0))
    rest = events.where(F.col(kind) == streamed).withColumn("__nth", F.row_number().over(W.partitionBy(session, name, args).orderBy(seq))).where("__nth = 1").drop("__nth")
    rest = rest.join(first.select(session, name, args).distinct(), [session, name, args], "left_anti").withColumn("source", F.lit(1))
    order = F.row_number().over(W.partitionBy(session).orderBy("source", seq))
    return first.unionByName(rest.select(first.columns)).withColumn("place", order)


def ordered_unique(df: DataFrame, group: str, refs: str, *order: str) -> DataFrame:
    """(group, ref, nth): the distinct entries of the arrays ``refs`` in order of first appearance."""
    flat = df.select(group, *order, F.posexplode_outer(refs).alias("__pos", "ref")).where("ref is not null")
    first = flat.groupBy(group, "ref").agg(F.min(F.struct(*order, "__pos")).alias("__at"))
    return first.select(group, "ref", F.row_number().over(W.partitionBy(group).orderBy("__at", "ref")).alias("nth"))


def tail(events: DataFrame, after: int, most: int, seq: str = "seq") -> DataFrame:
    """The next events past a reader's place."""
    return events.where(F.col(seq) > after).orderBy(seq).limit(most)


def rate_and_eta(done: DataFrame, pending: DataFrame, key: str, at: str, now: Column, window_seconds: int = 600) -> DataFrame:
    """Per key: what is pending, how many a second were done in the last window, and the seconds left at that rate."""
    recent = done.where(F.col(at) > now - F.make_dt_interval(secs=F.lit(window_seconds))).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    left = pending.groupBy(key).agg(F.count(F.lit(1)).alias("pending"))
    rate = F.round(F.coalesce("n", F.lit(0)) / window_seconds, 3)
    return left.join(recent, key, "left").select(key, "pending", rate.alias("rate"), F.when((rate > 0) & (F.col("pending") > 0), F.floor(F.col("pending") / rate)).alias("eta_seconds"))


def job_progress(jobs: DataFrame, now: Column, least_seconds: int = 5) -> DataFrame:
    """Running jobs' rate since their start and seconds left, where there is enough to tell."""
    elapsed = F.unix_timestamp(now) - F.unix_timestamp("started_at")
    delta = F.col("completed") - F.coalesce("start_completed", F.lit(0))
    known = (F.col("status") == "running") & (F.col("total") > 0) & (delta > 0) & (elapsed >= least_seconds)
    rate = F.when(known, delta / elapsed)
    return jobs.withColumn("rate_per_sec", F.round(rate, 3)).withColumn("eta_seconds", F.round(F.greatest(F.col("total") - F.col("completed"), F.lit(0)) / rate))


def reaped(jobs: DataFrame, now: Column, stale_seconds: int = 600) -> DataFrame:
    """Running jobs that haven't been heard of for long are stopped; all others are as they were."""
    stale = (F.col("status") == "running") & (F.unix_timestamp(now) - F.unix_timestamp("updated_at") > stale_seconds)
    return jobs.withColumn("detail", F.when(stale, "stale — process gone").otherwise(F.col("detail"))).withColumn("status", F.when(stale, "stopped").otherwise(F.col("status")))


def alive(jobs: DataFrame, now: Column, seconds: int = 90) -> DataFrame:
    return jobs.where((F.col("status") == "running") & (F.unix_timestamp(now) - F.unix_timestamp("updated_at") <= seconds))


def needs_reindex(rows: DataFrame, state: DataFrame, key: str, id: str, now: Column, least_new: int = 2000, most_age: int = 600) -> DataFrame:
    """Per key: new rows past what the index holds (``state``: key, indexed_max, indexed_at), and whether to rebuild.

    Rebuild at ``least_new`` new rows, or at any once the index is old enough.
    """
    seen = rows.join(F.broadcast(state), key, "left").groupBy(key).agg(
        F.count_if(F.col(id) > F.coalesce("indexed_max", F.lit(0))).alias("new"), F.max(id).alias("top"), F.first("indexed_at").alias("indexed_at")
    )
    old = F.col("indexed_at").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("indexed_at") >= most_age)
    return seen.select(key, "new", "top", ((F.col("new") > 0) & ((F.col("new") >= least_new) | old)).alias("rebuild"))


def outcomes(attempts: DataFrame, key: str) -> DataFrame:
    """How a backfill went: done, automatic, and failed by reason."""
    failed = F.col("error").isNotNull() | F.col("output").isNull() | (F.btrim("output") == "")
    reason = F.when(F.col("error").isNotNull(), "exception").when(F.col("output").isNull(), "missing_from_output").otherwise("empty_output")
    told = attempts.withColumn("__failed", failed).withColumn("__reason", F.when(failed, reason))
    return told.groupBy(key).agg(
        F.count_if(~F.col("__failed") & ~F.col("automatic")).alias("done"), F.count_if(~F.col("__failed") & F.col("automatic")).alias("auto"), F.count_if("__failed").alias("failed"),
        *(F.count_if(F.col("__reason") == r).alias(r) for r in ("exception", "missing_from_output", "empty_output")),
    )


def fresh_first(df: DataFrame, group: list[str], date: str, now: Column) -> DataFrame:
    """Groups by their last date, those of the last day first: (group, last, fresh)."""
    return df.groupBy(*group).agg(F.max(date).alias("last")).withColumn("fresh", F.col("last") > now - F.expr("INTERVAL 1 DAY")).orderBy(F.desc("fresh"), F.desc("last"), *group)


def page(df: DataFrame, *order: Column, limit: int, offset: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def ranking_quality(ranked: DataFrame, grades: DataFrame, k: int = 10, good: int = 2, high: int = 3) -> DataFrame:
    """Per query of (query, id, rank) against (query, id, grade): NDCG, precision, recall of good ones, and share of high ones found."""
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    found = ranked.where(F.col("rank") <= k).join(grades, ["query", "id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    dcg = found.groupBy("query").agg(F.sum(gain / F.log2(F.col("rank") + 1)).alias("dcg"), F.count_if(F.col("grade") >= good).alias("hits"), F.count_if(F.col("grade") >= high).alias("highs"))
    best = grades.withColumn("nth", F.row_number().over(W.partitionBy("query").orderBy(F.desc("grade"), "id")))
    ideal = best.groupBy("query").agg(F.sum(F.when(F.col("nth") <= k, gain / F.log2(F.col("nth") + 1))).alias("idcg"), F.count_if(F.col("grade") >= good).alias("goods"), F.count_if(F.col("grade") >= high).alias("all_high"))
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.coalesce(a, F.lit(0)) / F.col(b), 6))
    both = ideal.join(dcg, "query", "left")
    return both.select("query", F.coalesce(share("dcg", "idcg"), F.lit(0.0)).alias("ndcg"), F.round(F.coalesce("hits", F.lit(0)) / k, 6).alias("precision"), share("hits", "goods").alias("recall"), share("highs", "all_high").alias("high_capture"))


def wins(scores: DataFrame, first: str, second: str, least: float = 0.0) -> DataFrame:
    """How often one column beats the other by more than ``least``."""
    d = F.col(first) - F.col(second)
    return scores.agg(F.count_if(d > least).alias("wins"), F.count_if(d < -least).alias("losses"), F.count_if(F.abs(d) <= least).alias("ties"))


# fixed values: what makes a summary specific
_NUMBER, _NAME = r"\b\d[\d,.$]*", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+"
_DATE = r"(?i)\b(?:\d{1,2}/\d{1,2}(?:/\d{2,4})?|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\w*\s+\d{1,2}|\d{4}-\d{2}-\d{2})"


def specificity(summary: Column) -> Column:
    """Numbers, dates (twice) and names in a summary."""
    return F.coalesce(F.regexp_count(summary, F.lit(_NUMBER)) + 2 * F.regexp_count(summary, F.lit(_DATE)) + F.regexp_count(summary, F.lit(_NAME)), F.lit(0))


def _trigrams(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z']+"), F.lit(0))
    later = lambda k: F.slice(words, F.lit(k), F.greatest(F.size(words) - k + 1, F.lit(0)))
    join = lambda a, b: F.concat(a, F.lit(" "), b)
    return F.array_distinct(F.array_compact(F.zip_with(F.zip_with(words, later(2), join), later(3), join)))


def coverage(body: Column, summary: Column) -> Column:
    """Share of a summary's word triples that its body holds; 0 where there are none."""
    own = _trigrams(summary)
    return F.coalesce(F.when(F.size(own) > 0, F.size(F.array_intersect(_trigrams(body), own)) / F.size(own)), F.lit(0.0))


def summary_quality(runs: DataFrame) -> DataFrame:
    """Per run of (run, body, summary, error, ms): medians, specificity, coverage and the blended score, best first."""
    fine = F.col("summary").isNotNull() & (F.col("summary") != "") & F.col("error").isNull()
    own = runs.withColumn("fine", fine)
    pick = lambda c: F.when(F.col("fine"), c)
    out = own.groupBy("run").agg(
        F.count_if("fine").alias("ok"), F.count_if(~F.col("fine")).alias("failed"), F.floor(F.percentile(pick(F.length("summary")), F.lit(0.5))).alias("med_len"),
        F.coalesce(F.sum(pick(specificity(F.col("summary")))), F.lit(0)).alias("spec_total"), F.round(F.coalesce(F.avg(pick(coverage(F.col("body"), F.col("summary")))), F.lit(0.0)), 3).alias("cov_avg"),
        F.floor(F.percentile(pick(F.col("ms")), F.lit(0.5))).alias("med_ms"),
    )
    return out.withColumn("score", F.round(F.col("spec_total") + 500 * F.col("cov_avg") - 20 * F.col("failed"), 6)).orderBy(F.desc("score"), "run")


def needs_rerank(results: DataFrame, score: str = "score", top: int = 5, spread: float = 0.05, least: int = 3) -> DataFrame:
    """One row: whether the best results lie so close that a second ranking is worth it."""
    best = results.orderBy(F.desc(score)).limit(top)
    many = results.agg(F.count(F.lit(1)).alias("n"))
    return best.agg((F.max(score) - F.min(score)).alias("spread")).join(F.broadcast(many)).select(((F.col("n") > least) & (F.col("spread") < spread)).alias("rerank"))
