"""Joins that aren't on equal keys, as joins that are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, value: str, bucket_seconds: int = 86400) -> DataFrame:
    """``left`` with the ``value`` of the right row of the same key that has the greatest (``at``, ``value``) not after its own ``at``, or null.

    Each key is split into buckets of time, so that no task holds a whole hot key:
    a row looks back in its own bucket, then at the last value of the buckets before it.
    Rows with a null key or time find nothing; right rows with a null in any of the three columns are never found.
    """
    bucket = F.floor(F.unix_timestamp(F.col(at).cast("timestamp")) / bucket_seconds)
    known = right.where(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(value).isNotNull())
    found = known.select(F.col(key).alias("__key"), F.col(at).alias("__at"), bucket.alias("__bucket"), F.col(value).alias("__value"))
    asking = left.select(F.col(key).alias("__key"), F.col(at).alias("__at"), bucket.alias("__bucket"), F.struct(*left.columns).alias("__row"))
    rows = asking.unionByName(found, allowMissingColumns=True).withColumn("__asks", F.col("__row").isNotNull())
    inside = W.partitionBy("__key", "__bucket").orderBy("__at", "__asks", "__value").rowsBetween(W.unboundedPreceding, 0)
    near = rows.withColumn("__near", F.last("__value", ignorenulls=True).over(inside)).where("__asks")

    # one row for each key and bucket
    ends = found.groupBy("__key", "__bucket").agg(F.max_by("__value", F.struct("__at", "__value")).alias("__end"))
    buckets = asking.select("__key", "__bucket").distinct().join(ends, ["__key", "__bucket"], "full")
    before = W.partitionBy("__key").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = buckets.select("__key", "__bucket", F.last("__end", ignorenulls=True).over(before).alias("__before"))
    return near.join(carried, ["__key", "__bucket"], "left").select("__row.*", F.coalesce("__near", "__before").alias(value))


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with ``low <= point <= high``; a range is copied to each bin of ``width`` that it touches, and bins join on equality.

    A null point, a null end or a range whose ends are the wrong way round joins with nothing.
    """
    first, last = (F.floor(F.col(c) / width).cast("long") for c in (low, high))
    copies = ranges.where(F.col(low) <= F.col(high)).withColumn("__bin", F.explode(F.sequence(first, last)))
    placed = points.withColumn("__bin", F.floor(F.col(point) / width).cast("long"))
    return placed.join(copies, "__bin").where(F.col(point).between(F.col(low), F.col(high))).drop("__bin")


def range_counts(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """``ranges`` with ``n``, how many points lie in ``low <= point <= high``, for those that hold any; no pair is built.

    Distinct values and ends are counted up in order inside bins of ``width``, and bins (one row each) from the first on;
    a range's count is what is up to its high end less what is before its low one.
    """
    fit = ranges.where(F.col(low) <= F.col(high))
    ends = lambda c, side: fit.select(F.col(c).alias("__at")).distinct().select("__at", F.lit(side).alias("__side"), F.lit(0).cast("long").alias("__n"))
    told = points.where(F.col(point).isNotNull()).groupBy(F.col(point).alias("__at")).agg(F.count(F.lit(1)).alias("__n")).select("__at", F.lit(1).alias("__side"), "__n")
    at = F.col("__at").cast("double")
    rows = ends(low, 0).union(told).union(ends(high, 2)).withColumn("__bin", F.when(F.isnan(at), F.lit(2**63 - 1)).otherwise(F.floor(at / width)))
    inside = W.partitionBy("__bin").orderBy("__at", "__side").rowsBetween(W.unboundedPreceding, 0)
    near = rows.withColumn("__near", F.sum("__n").over(inside)).where("__side <> 1")
    before = W.orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)
    carried = rows.groupBy("__bin").agg(F.sum("__n").alias("__all")).select("__bin", F.coalesce(F.sum("__all").over(before), F.lit(0)).alias("__before"))
    up = near.join(carried, "__bin").withColumn("__up", F.col("__near") + F.col("__before"))
    of = lambda c, side, name: up.where(F.col("__side") == side).select(F.col("__at").alias(c), F.col("__up").alias(name))
    return fit.join(of(low, 0, "__less"), low).join(of(high, 2, "__most"), high).withColumn("n", F.col("__most") - F.col("__less")).where("n > 0").select(*ranges.columns, "n")


def longest_prefix(keys: DataFrame, prefixes: DataFrame, key: str, prefix: str, value: str, default: float) -> DataFrame:
    """The distinct keys with the ``value`` of their longest prefix, or ``default``; a key's prefixes join on equality."""
    distinct = keys.select(key).distinct()
    lengths = F.when(F.length(key) > 0, F.sequence(F.lit(1), F.length(key)))
    tried = distinct.select(key, F.explode_outer(F.transform(lengths, lambda n: F.substr(F.col(key), F.lit(1), n))).alias("__prefix"))
    own = prefixes.select(F.col(prefix).alias("__prefix"), F.col(value).alias("__value"))
    best = tried.join(own, "__prefix", "left").groupBy(key).agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.length("__prefix"))).alias("__value"))
    return best.select(key, F.coalesce("__value", F.lit(default)).alias(value))
