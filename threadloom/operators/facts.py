"""Search over atomic facts: meaning and words together, and facts that say the same once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.cleaning import STOP_WORDS, VALUE, query_terms, singular
from threadloom.operators.search import bm25, dot

FLOOR, CAP, RRF_K, OWNER_BOOST, COLLAPSE, MAX_LOAD = 0.5, 500, 60, 0.02, 0.97, 8000


def fact_terms(query: str) -> list[str]:
    """A query's telling words with their singulars."""
    return [x for w in query_terms(query) for x in (w, singular(w)) if x is not None and (x == w or x not in STOP_WORDS)]


def find_facts(facts: DataFrame, query: str, vector: list[float], floor: float = FLOOR, cap: int = CAP, exhaustive: bool = True, top: int = 20, owner: tuple[str, ...] = (), k: int = RRF_K, boost: float = OWNER_BOOST, max_load: int = MAX_LOAD) -> DataFrame:
    """Facts (id, text, embedding, more) near ``vector`` or with a word of ``query``, by fused rank; of equal texts the first.

    Exhaustive: all of cosine ``floor`` or more and all that have a word (``4 * cap``
    best); else the ``top`` of both.  Of more than ``max_load`` facts only those with a word
    are ranked, so what is ranked is bounded.  Facts that name the owner are lifted.  Ties go
    to the smaller id.
    """
    size = float(np.sqrt(np.square(vector).sum()) + 1e-8)
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)) + 1e-8
    near = facts.select("id", F.round(dot(F.col("embedding"), vector) / length / size, 6).alias("cosine"))
    terms = fact_terms(query)
    if terms:
        words = bm25(facts, terms, "id", "text").orderBy(F.desc("score"), "id").limit(4 * cap)
        words = words.select("id", F.row_number().over(W.orderBy(F.desc("score"), "id")).alias("word"))
        near = near.join(F.broadcast(words), "id", "left")
    else:
        near = near.withColumn("word", F.lit(None).cast("int"))
    total = facts.agg(F.count(F.lit(1)).alias("__total"))
    near = near.join(F.broadcast(total)).where((F.col("__total") <= max_load) | F.col("word").isNotNull()).drop("__total")
    near = near.withColumn("sem", F.row_number().over(W.orderBy(F.desc("cosine"), "id")))
    wanted = ((F.col("cosine") >= floor) | F.col("word").isNotNull()) if exhaustive else ((F.col("sem") <= top) | (F.col("word") <= top))
    owned = F.lit(False)
    for name in owner:
        owned = owned | F.lower("text").contains(name.lower())
    part = lambda c: F.coalesce(1 / (k + F.col(c)), F.lit(0.0))
    found = facts.join(near.where(wanted), "id").withColumn("owner", owned)
    found = found.withColumn("rrf", F.round(part("sem") + part("word") + F.when(F.col("owner"), boost).otherwise(0.0), 9))
    first = F.row_number().over(W.partitionBy("text").orderBy(F.desc("rrf"), "id"))
    found = found.withColumn("__first", first).where("__first = 1").drop("__first", "sem").withColumn("bm25", F.col("word").isNotNull()).drop("word")
    return found.orderBy(F.desc("rrf"), "id").limit(cap)


def _content(text: str) -> tuple[frozenset[str], frozenset[str]]:
    """(telling words, words that hold a digit)."""
    words = re.findall(r"[a-z0-9]+", text.lower())
    return frozenset(w for w in words if len(w) >= 3 and w not in STOP_WORDS), frozenset(re.findall(VALUE, text.lower()))


def collapse_near_duplicates(found: DataFrame, threshold: float = COLLAPSE) -> DataFrame:
    """What ``find_facts`` returns (at most its cap), each fact once with ``dup_count``.

    In order of rank, a fact goes if one before it stays that is as near as
    ``threshold``, shares a telling word and holds the same values (numbers, dates, codes).
    The order is what decides, so this one small table is walked in one place.
    """
    kept = [f for f in found.schema.fields]

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rrf", "id"], ascending=[False, True], ignore_index=True)
        x = np.stack([np.asarray(v, np.float64) for v in rows["embedding"]])
        x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-8
        content = [_content(t) for t in rows["text"]]
        stay: list[int] = []
        count = np.zeros(len(rows), np.int64)
        for i in range(len(rows)):
            near = [j for j, c in zip(stay, x[stay] @ x[i], strict=True) if c >= threshold and content[i][0] & content[j][0] and content[i][1] == content[j][1]] if stay else []
            if near:
                count[near[0]] += 1
            else:
                stay.append(i)
        return rows.iloc[stay].assign(dup_count=count[stay])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if held:
            yield walk(pd.concat(held, ignore_index=True))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", dup_count long"
    return found.coalesce(1).mapInPandas(run, schema)


def conflicting(a: str, b: str) -> bool:
    """Whether two facts hold different values."""
    return _content(a)[1] != _content(b)[1]
