"""What a table holds after a batch of changes; the result is written as a new version of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key it doesn't hold; ``new`` has a key once."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def partial_upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """As ``upsert``, but a null in ``new`` leaves the old value."""
    rest = [c for c in old.columns if c not in keys]
    fresh = new.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in rest])
    return old.join(fresh, keys, "full").select(*keys, *[F.coalesce(f"__new_{c}", c).alias(c) for c in rest])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old``, and the rows of ``new`` whose key it doesn't hold."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def delete_stale(old: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` whose key the source still holds."""
    return old.join(source.select(*keys).distinct(), keys, "left_semi")


def append_sequenced(log: DataFrame, new: DataFrame, key: str, seq: str, *order: Column) -> DataFrame:
    """``new`` numbered within its key from the log's greatest number on, from 1 where the log has none."""
    top = log.groupBy(key).agg(F.max(seq).alias("__top"))
    nth = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return new.withColumn("__nth", nth).join(top, key, "left").withColumn(seq, F.coalesce("__top", F.lit(0)) + F.col("__nth")).drop("__nth", "__top")


def unexpired(entries: DataFrame, keys: list[str], expires: str, as_of: Column, *order: Column) -> DataFrame:
    """The latest entry of each key, unless it has expired."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return entries.withColumn("__nth", nth).where((F.col("__nth") == 1) & (F.col(expires).isNull() | (F.col(expires) >= as_of))).drop("__nth")
