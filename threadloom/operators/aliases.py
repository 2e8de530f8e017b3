"""Abbreviations and what they stand for, from messages that use both; counts are additive, so batches add up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHORT, LEAST_SEEN, LEAST_BOTH, LEAST_JACCARD = 5, 3, 5, 0.2


def terms_of(text: Column, short: int = SHORT) -> tuple[Column, Column]:
    """(abbreviations of a text in lower case, sorted, its words and word pairs), both distinct.

    Pairs are matched in the joined words and not put together by a lambda, which Spark would
    interpret for each word, and with it all that ``text`` is made of.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{2,}"), F.lit(0))
    pairs = F.regexp_extract_all(F.array_join(words, " "), F.lit("(?<![a-z])(?=([a-z]+ [a-z]+))"), F.lit(1))
    abbreviations = F.split(F.lower(F.array_join(F.regexp_extract_all(text, F.lit(rf"\b[A-Z]{{2,{short}}}\b"), F.lit(0)), " ")), " ")
    return F.array_sort(F.array_distinct(F.array_remove(abbreviations, ""))), F.array_distinct(F.concat(words, pairs))


def counts(messages: DataFrame, text: Column, short: int = SHORT) -> DataFrame:
    """One batch's run (abbreviations, expansion, n): in how many messages a word or pair longer than ``short`` stands beside just these abbreviations.

    Abbreviations are one text of words; the messages themselves count under an empty expansion.
    So a message has one row for each of its terms, however many abbreviations it has.
    """
    abbreviations, long = terms_of(text, short)
    own = messages.select(F.array_join(abbreviations, " ").alias("abbreviations"), F.concat(F.array(F.lit("")), long).alias("long"))
    # the generator reads both columns, or Spark would work out the abbreviations again for each of its rows
    terms = F.explode(F.when(F.col("abbreviations").isNotNull(), F.col("long")))
    rows = own.select("abbreviations", terms.alias("expansion")).where((F.col("expansion") == "") | (F.length("expansion") > short))
    return rows.groupBy("abbreviations", "expansion").agg(F.count(F.lit(1)).alias("n"))


def added(runs: list[DataFrame], *keys: str) -> DataFrame:
    """Runs of counts as one: what merging sorted runs gives, and what compaction writes."""
    return reduce(DataFrame.unionByName, runs).groupBy(*keys).agg(F.sum("n").alias("n"))


def discover(run: DataFrame, least_seen: int = LEAST_SEEN, least_both: int = LEAST_BOTH, least_jaccard: float = LEAST_JACCARD, tried: int = 20, kept: int = 3) -> DataFrame:
    """(term, expansion, n, jaccard, nth): of an abbreviation's ``tried`` commonest companions the first ``kept`` that overlap enough.

    An expansion in fewer than ``least_both`` messages is in no pair that counts, so only others are paired.  An
    abbreviation's first companion is the empty one, which tells in how many messages it is.
    """
    frequent = run.withColumn("df_expansion", F.sum("n").over(W.partitionBy("expansion"))).where(F.col("df_expansion") >= least_both)
    each = frequent.select(F.explode(F.split("abbreviations", " ")).alias("term"), "expansion", "n", "df_expansion").where((F.col("term") != "") & ~F.col("expansion").contains(F.col("term")))
    pairs = each.groupBy("term", "expansion").agg(F.sum("n").alias("n"), F.max("df_expansion").alias("df_expansion")).where(F.col("n") >= least_both)
    near = pairs.withColumn("__nth", F.row_number().over(W.partitionBy("term").orderBy(F.desc("n"), "expansion"))).where(F.col("__nth") <= tried + 1)
    told = near.withColumn("df_term", F.max("n").over(W.partitionBy("term"))).where((F.col("df_term") >= least_seen) & (F.col("expansion") != ""))
    scored = told.withColumn("jaccard", F.col("n") / (F.col("df_term") + F.col("df_expansion") - F.col("n"))).where(F.col("jaccard") >= least_jaccard)
    nth = F.row_number().over(W.partitionBy("term").orderBy("__nth"))
    return scored.withColumn("nth", nth).where(F.col("nth") <= kept).select("term", "expansion", "n", F.round("jaccard", 6).alias("jaccard"), "nth")


def caps_vocabulary(messages: DataFrame, id: str, subject: str, body: str, least_df: int = 5, least_ratio: float = 0.7, most: int = 4000, contexts: int = 3, width: int = 220) -> DataFrame:
    """Words mostly written in capitals: in how many messages so and otherwise, with passages of the first messages.

    A message counts for both ways of writing if it holds both.
    """
    text = F.concat(F.coalesce(F.col(subject), F.lit("")), F.lit("\n"), F.coalesce(F.col(body), F.lit("")))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Za-z]{2,5}\b"), F.lit(0)))
    own = messages.select(F.col(id).alias("id"), F.col(subject).alias("subject"), text.alias("text"), found.alias("found"))
    caps = F.col("word") == F.upper("word")
    seen = own.select("id", F.explode("found").alias("word")).select("id", F.lower("word").alias("term"), caps.alias("caps")).distinct().groupBy("term").agg(F.count_if("caps").alias("caps_df"), F.count_if(~F.col("caps")).alias("other_df"))
    fit = seen.where((F.col("caps_df") >= least_df) & (F.col("caps_df") / (F.col("caps_df") + F.col("other_df")) >= least_ratio)).orderBy(F.desc("caps_df"), "term").limit(most)
    # at most ``most`` terms
    raised = own.select("id", "subject", "text", F.explode(F.filter("found", lambda w: w == F.upper(w))).alias("word")).withColumn("term", F.lower("word"))
    shown = raised.join(F.broadcast(fit.select("term")), "term").withColumn("nth", F.row_number().over(W.partitionBy("term").orderBy("id"))).where(F.col("nth") <= contexts)
    # a word of five letters may be the end of a longer one, as ``found`` takes it
    at = F.regexp_instr("text", F.concat(F.when(F.length("word") < 5, r"(?<![A-Za-z])").otherwise(""), F.col("word"), F.lit(r"\b")))
    passage = F.btrim(F.replace(F.substring("text", F.greatest(at - width // 2, F.lit(1)), F.lit(width)), F.lit("\n"), F.lit(" ")))
    texts = shown.groupBy("term").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.concat(F.lit("[subject: "), F.substring("subject", 1, 90), F.lit("] …"), passage, F.lit("…")).alias("c")))), lambda r: r["c"]).alias("contexts"))
    return fit.join(texts, "term", "left")


def spell_dictionary(words: DataFrame, names: DataFrame, floor: int = 20, longest: int = 24, boost: int = 50) -> DataFrame:
    """(word, n) from counts of words and distinct sender names: each word of a name adds ``boost``; rare and very long words go."""
    lifted = names.select(F.explode(F.regexp_extract_all(F.lower("name"), F.lit("[a-z]{2,}"), F.lit(0))).alias("word")).groupBy("word").agg((F.count(F.lit(1)) * boost).alias("n"))
    return added([words.select("word", "n"), lifted], "word").where((F.col("n") >= floor) & (F.length("word") <= longest))
