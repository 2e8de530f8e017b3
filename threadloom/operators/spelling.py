"""Spelling by symmetric deletion: words within two edits share what is left of both after at most two deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORTEST, MOST_EDITS = 3, 2


def deletions(word: Column, most: int = MOST_EDITS) -> Column:
    """The word and all it can become by deleting at most ``most`` letters."""

    def without_one(w: Column) -> Column:
        places = F.when(F.length(w) > 0, F.sequence(F.lit(1), F.length(w))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))

    last = out = F.array(word)
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(last, without_one)))
        out = F.concat(out, last)
    return F.array_distinct(out)


def corrected(words: DataFrame, dictionary: DataFrame, most: int = MOST_EDITS, shortest: int = SHORTEST) -> DataFrame:
    """(word, fixed, edits) of distinct ``words`` (word) that ``dictionary`` (word, n) lacks and has a word near of.

    The nearest counts, then the commonest, then the first by letters.  Words shorter than
    ``shortest`` and those with a colon are left alone.  Each word meets only those it
    shares a rest with, and every pair is measured.
    """
    asked = words.select("word").distinct().where((F.length("word") >= shortest) & ~F.contains("word", F.lit(":"))).join(dictionary.select("word"), "word", "left_anti")
    rest = lambda df, name, *more: df.select(F.col("word").alias(name), *more, F.explode(deletions(F.col("word"), most)).alias("rest"))
    pairs = rest(asked, "word").join(rest(dictionary, "fixed", "n"), "rest").select("word", "fixed", "n").distinct()
    near = pairs.withColumn("edits", F.levenshtein("word", "fixed", most)).where("edits >= 0")
    best = near.groupBy("word").agg(F.min(F.struct("edits", (-F.col("n")).alias("less"), "fixed")).alias("b"))
    return best.select("word", F.col("b.fixed").alias("fixed"), F.col("b.edits").alias("edits"))
