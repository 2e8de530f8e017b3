"""Range shards of an integer key, balanced by weight: the same rows give the same shards on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.shared import cut, free_name

#: The key's range is cut into so many equal cells; a cell heavier than a shard is cut again.
CELLS = 1 << 14
#: The most shards; larger tables get heavier ones.
SHARDS = 1 << 16


def with_shard(df: DataFrame, key: str, weight: Column, target: int, within: Column, sized: DataFrame | None = None) -> tuple[DataFrame, str, int]:
    """(``df`` with a shard number ascending in ``key``, its column's name, the number of shards).

    ``weight`` is a column of ``sized`` (``df`` itself by default); a shard closes
    once it weighs ``target``.  Null keys come first.  Rows of one key too heavy for a
    shard are cut by ``within``, an integer made from columns of both tables; rows equal
    in both share a shard.  The driver sees one row for each cell with rows.
    """
    spark = df.sparkSession
    sized = df if sized is None else sized
    sizes = sized.select(F.col(key).alias("k"), within.cast("long").alias("w"), F.coalesce(weight, F.lit(0)).cast("long").alias("weight"))
    ends = sizes.agg(F.min("k").alias("low"), F.max("k").alias("high"), F.sum("weight").alias("all")).first()
    low, high = (0, 0) if ends["low"] is None else (ends["low"], ends["high"])
    width = (high - low) // CELLS + 1
    target = max(target, (ends["all"] or 0) // SHARDS)
    cell, shard, cuts = (free_name(df, x) for x in ("__cell", "__shard", "__cut"))

    def first(k: Column) -> Column:
        return F.when(k.isNull(), F.lit(0)).otherwise(1 + _steps(k, F.lit(low).cast("decimal(38,0)"), F.lit(width).cast("decimal(38,0)"))).cast("long")

    def again(rows: DataFrame, level: DataFrame, k: Column, w: Column) -> DataFrame:
        x = F.when(F.col(f"{cuts}.by_key"), k).otherwise(w)
        deeper = F.col(f"{cuts}.base") + _steps(x, F.col(f"{cuts}.low"), F.col(f"{cuts}.width"))
        return rows.join(F.broadcast(level), cell, "left").withColumn(cell, F.coalesce(deeper, F.col(cell))).drop(cuts)

    levels: list[DataFrame] = []
    place, weights, following = {}, {}, CELLS + 2
    below: dict[int, tuple[tuple[int, ...], int]] = {}
    placed = sizes.withColumn(cell, first(F.col("k")))
    while True:
        seen = placed.groupBy(cell).agg(F.sum("weight").alias("n"), F.min("k").alias("k0"), F.max("k").alias("k1"), F.min("w").alias("w0"), F.max("w").alias("w1")).collect()
        heavy = []
        for r in seen:
            c = r[cell]
            above, base = below.get(c, ((), 0))
            place[c] = (*above, c - base)
            if r["n"] > target and (r["k0"] != r["k1"] or r["w0"] != r["w1"]):
                heavy.append(r)
            else:
                weights[c] = r["n"]
        if not heavy:
            break
        parts, rows = max(16, CELLS // len(heavy)), []
        for r in sorted(heavy, key=lambda r: r[cell]):
            by_key = r["k0"] != r["k1"]
            a, b = (r["k0"], r["k1"]) if by_key else (r["w0"], r["w1"])
            step = (b - a) // parts + 1
            rows.append((r[cell], (by_key, following, str(a), str(step))))
            for c in range(following, following + (b - a) // step + 1):
                below[c] = (place[r[cell]], following)
            following += (b - a) // step + 1
        level = spark.createDataFrame(rows, f"`{cell}` long, `{cuts}` struct<by_key: boolean, base: long, low: string, width: string>")
        number = "decimal(38,0)"
        level = level.select(cell, F.struct(F.col(f"{cuts}.by_key"), F.col(f"{cuts}.base"), F.col(f"{cuts}.low").cast(number).alias("low"), F.col(f"{cuts}.width").cast(number).alias("width")).alias(cuts))
        if not levels:
            placed = cut(placed)
        levels.append(level)
        placed = again(placed.join(F.broadcast(level.select(cell)), cell, "left_semi"), level, F.col("k"), F.col("w"))
    of, now, held = [], 0, 0
    for c in sorted(weights, key=place.__getitem__):
        if held >= target:
            now, held = now + 1, 0
        of.append((c, now))
        held += weights[c]
    out = df.withColumn(cell, first(F.col(key)))
    for level in levels:
        out = again(out, level, F.col(key), within.cast("long"))
    last = spark.createDataFrame(of, f"`{cell}` long, `{shard}` int")
    return out.join(F.broadcast(last), cell).drop(cell), shard, now + 1


def _steps(x: Column, low: Column, width: Column) -> Column:
    return F.call_function("div", x.cast("decimal(38,0)") - low, width).cast("long")


__all__ = ["with_shard"]
