"""A training corpus in four steps over ``documents``; each step's table is written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import bpe, jaccard_join, lang_id, mixing
from threadloom.llm.shared import cut, free_name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep all documents but those op2 calls undetermined (null text, no letter, or no labelled document to learn from).

    A low score is no reason to go: short or little telling texts score below 0.5 in every language.
    """
    model = lang_id.fit(docs.where(lang_id.fold("doc_id", 4) != 2))
    lang, score = free_name(docs, "__lang"), free_name(docs, "__score")
    told = lang_id.predict(docs, model, lang=lang, score=score)
    return told.where(F.col(lang) != lang_id.UNDETERMINED).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates: the one of the least id, then of the least text digest.

    Groups are of rows, not of ids: a repeated id with another text is a row of its own, and rows
    without an id come last in their group.  Of rows alike in id (null included) and text one stays.
    Texts without words link to nothing.
    """
    row = free_name(docs, "__row")
    own = docs.withColumn(row, F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text")))
    linked = cut(jaccard_join.link(own, key=row))
    kept = own.join(linked.where(F.col(row) == F.col("component_id")).select(row), row, "left_semi")
    repeated = linked.groupBy(row).count().where("count > 1").select(row)
    if repeated.isEmpty():
        return kept.select(docs.columns)
    once = kept.join(repeated, row, "left_anti").unionByName(kept.join(repeated, row, "left_semi").dropDuplicates([row]))
    return once.select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix of sources wants it; rows of one id and size stand in the order of their texts' digests."""
    size, *names = (free_name(docs, f"__{x}") for x in ("size", *mixing.NAMES))
    sized = docs.withColumn(size, mixing.word_count("text"))
    mixed = mixing.sample(sized, size=size, ties=(F.xxhash64("text"),), names=tuple(names))
    return mixing.emit(mixed, copies=names[2]).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"), keep_text=False)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("mixing", mix), ("bpe", tokens)]

#: Language identification and near-duplicate search are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
