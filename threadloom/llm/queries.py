"""The subpackage's queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import bpe, html_main, ivfpq, jaccard_join, lang_id, lbl_lm, lexical, merkle, mixing, oracles, token_bin, token_count, vec_dedup, warc
from threadloom.llm.shared import cut, shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_text=False)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", lang_id.fold("doc_id", 4) == 2)
    model = lang_id.fit(docs.where(~F.col("held_out")))
    return lang_id.predict(docs.select("doc_id", "text", "held_out"), model, keep_text=False)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, path, keep_text=False), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_token_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "tokens")
    token_bin.write(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_bin.read(spark, folder, with_ids=False)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count("text").alias("size"))
    mixed = mixing.sample(cut(docs))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lbl_lm.score(_table(spark, sf_dir, "documents"), lang_id.fold("doc_id", 7) != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vec_dedup.link(_table(spark, sf_dir, "embeddings"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivfpq.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_main.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build(_table(spark, sf_dir, "documents"))
    return lexical.search(index, _table(spark, sf_dir, "benchmark"), k=50)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    proved = merkle.manifest(docs, {"n_chars": F.col("n_chars") + 1}, F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    return proved.select("doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_language_id, op3_bpe, op4_jaccard_join, op5_warc, op6_token_bin, op7_mixing, op8_lm_scoring, op9_vector_dedup, op10_nearest, op11_html_text, op12_lexical, op13_merkle)
}
ORACLE_SQL: dict[str, str] = {"op12_lexical": oracles.LEXICAL, "op13_merkle": oracles.MERKLE}
