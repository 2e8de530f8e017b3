"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Targets: sources in code-point order (null last) take the given weights in turn
and share a multiple of all sizes; a target stops at ``cap`` times its source's
size and the excess is shared again by weight, until none is above.  That end is
a water level: with sources ordered by cap over weight, a running sum gives it.

Sampling: every document of a source is expected ``target / size`` times, the
documents of a source stand in a fixed order (a size class of an eighth of a
doubling, a hashed salt, the key), the running sum of expected copies is shifted by
one offset drawn for the source, and a document is emitted once for each integer
its interval crosses.  Ordering by size class keeps the words taken near the
target.  The position in that order is a bucket's start plus the row's place in
its (source, class, salt) bucket, so no source is ever in one task.

Null text has size 0, null source is a source of its own, rows with equal keys
stand side by side in order of size and ``ties``, an empty table gives an empty table, and
the same rows and seed give the same copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm.shared import free_name

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
CAP = 2
#: The least number of buckets of a source's size class, and how many rows of the table ask for one more.
SALTS, ROWS_PER_SALT = 256, 1_000_000
SEED = "mix"
NAMES = ("source_size", "target", "copies")


def word_count(text: str | Column) -> Column:
    """Number of runs of characters other than ASCII white space; null: 0."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, source: str, size: str, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) of a table with one row for each source."""
    order = W.orderBy(F.col(source).isNull(), source)
    level = W.orderBy(F.col("cap") / F.col("weight"), F.col(source).isNull(), source)
    whole = W.partitionBy()
    return (
        sizes.select(source, F.col(size).alias("source_size"))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * cap)
        .withColumn("budget", F.sum("source_size").over(whole) * share_percent / F.lit(100))
        .withColumn("before", F.coalesce(F.sum("cap").over(level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("after", F.sum("weight").over(level.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("before")) / F.col("after"))
        .withColumn("capped", F.col("level") * F.col("weight") > F.col("cap"))
        .withColumn("level", F.max(F.when(~F.col("capped"), F.col("level"))).over(whole))
        .select(source, "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"))
    )


def _hash(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def sample(df: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", seed: str = SEED, salts: int | None = None, ties: tuple[Column, ...] = (), names: tuple[str, str, str] = NAMES) -> DataFrame:
    """``df`` with its source's size and target and the copies the mix takes of the row, under ``names``.

    Columns of ``df`` that already have such a name give way to them.  ``ties`` order rows
    of equal key and size.  ``df`` is counted, and read
    twice: once for the bucket counts, once for the rows.  The number of buckets (``salts``)
    grows with the table, so a bucket's rows don't; the table alone decides it.
    """
    salts = salts or max(SALTS, -(-df.count() // ROWS_PER_SALT))
    df = df.drop(*names)
    none, name, band, salt, place, of = (free_name(df, x) for x in ("__none", "__source", "__band", "__salt", "__place", "__of"))
    bits = F.bin(F.col(size))
    rows = (
        df.withColumn(none, F.col(source).isNull())
        .withColumn(name, F.coalesce(F.col(source).cast("string"), F.lit("")))
        .withColumn(band, F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.rpad(F.substring(bits, 1, 4), 4, "0")))
        .withColumn(salt, F.coalesce(_hash(F.col(key).cast("string"), 8) % salts, F.lit(0)))
    )
    bucket = [none, name, band, salt]
    counted = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("words"))
    by_band = counted.groupBy(none, name, band).agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    before_band = by_band.select(none, name, band, F.coalesce(F.sum("n").over(W.partitionBy(none, name).orderBy(band).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("band_start"))
    total = by_band.groupBy(none, name).agg(F.sum("words").alias("words")).withColumn("s", F.when(~F.col(none), F.col(name)))
    goal = targets(total.select("s", "words"), "s", "words")
    goal = goal.select(
        F.col("s").isNull().alias(none),
        F.coalesce("s", F.lit("")).alias(name),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
        (_hash(F.concat(F.lit(f"{seed}/"), F.coalesce("s", F.lit(""))), 8) / F.lit(float(1 << 32))).alias("offset"),
    )
    starts = (
        counted.select(*bucket, F.coalesce(F.sum("n").over(W.partitionBy(none, name, band).orderBy(salt).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("salt_start"))
        .join(before_band, [none, name, band])
        .join(goal, [none, name])
        .select(*bucket, F.struct((F.col("band_start") + F.col("salt_start")).alias("start"), "source_size", "target", "rate", "offset").alias(of))
    )
    placed = rows.withColumn(place, F.row_number().over(W.partitionBy(*bucket).orderBy(key, size, *ties)) - 1).join(starts, bucket)
    rate, offset, at = F.col(f"{of}.rate"), F.col(f"{of}.offset"), F.col(f"{of}.start") + F.col(place)
    crossed = F.floor((at + 1) * rate + offset) - F.floor(at * rate + offset)
    added = F.col(f"{of}.source_size"), F.col(f"{of}.target"), crossed.cast("long")
    return placed.select(*map(F.col, df.columns), *(x.alias(n) for x, n in zip(added, names, strict=True)))


def emit(df: DataFrame, copies: str = "copies") -> DataFrame:
    """Each row as often as ``copies`` says, without that column."""
    times = free_name(df, "__time")
    return df.where(F.col(copies) > 0).withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).drop(times, copies)
