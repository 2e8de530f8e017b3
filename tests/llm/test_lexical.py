"""The tree search against scoring every document, and its SQL."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from threadloom.llm import lexical, queries
from threadloom.llm.oracles import LEXICAL

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _expected(docs, items, k=50):
    counted = [(key, Counter(_terms(text))) for key, text in docs]
    n, words = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        found = []
        for key, c in counted:
            score = 0
            for t in set(_terms(text)) & set(c):
                m = 50 + (50 * sum(c.values()) * n) // words
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, key is None, key))
        out += [(item, rank, key, -score) for rank, (score, _, key) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def _sorted(rows):
    return sorted(rows, key=str)


def _docs(n):
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)] + ["Été", "straße", "字字", "A1", "it's", "x y"]
    docs = [(i * 3 % 1009, rng.choice([" ", "\n", "-"]).join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    docs += [(None, "w1 w2 w3 Été"), (5, None), (6, ""), (7, "... !!"), (8, "w1 w2"), (8, "w1 w2"), (9, "w5 " * 70_000 + "w1 " * 300_000)]
    return docs


def _items():
    rng = random.Random(4)
    items = [(i, " ".join(f"w{int(rng.paretovariate(0.5))}" for _ in range(rng.randint(1, 30)))) for i in range(300)]
    return items + [(900, None), (901, ""), (902, "nowhere"), (903, "ÉTÉ Été a1 字字"), (903, "w1"), (903, "w1"), (None, "w2 w3"), (904, "w1 w2")]


@pytest.mark.parametrize(("docs", "leaf_rows"), [(700, 16), (0, 16)])
def test_search(spark, monkeypatch, docs, leaf_rows):
    monkeypatch.setattr(lexical, "TERMS", 5000)
    docs, items = _docs(docs) if docs else [], _items()
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = lexical.build(table)
    assert not docs or index.where("term IS NULL").count() > 3
    for k in (3, 50):
        got = lexical.search(index, spark.createDataFrame(items, "item_id long, text string").repartition(2), k=k)
        assert _sorted(tuple(r) for r in got.collect()) == _sorted(_expected(docs, items, k) if docs else [])


def test_added_segments(spark):
    """A second build beside the first is searched like one over all."""
    docs, items = _docs(300), _items()[:40]
    halves = [lexical.build(spark.createDataFrame(part, "doc_id long, text string").coalesce(1)) for part in (docs[:150], docs[150:])]
    second = halves[1].withColumn("segment", halves[1]["segment"] + (1 << 60))
    got = lexical.search(halves[0].union(second), spark.createDataFrame(items, "item_id long, text string"), k=10)
    assert _sorted(tuple(r) for r in got.collect()) == _sorted(_expected(docs, items, 10))


def test_query_and_sql(spark, tmp_path):
    docs, items = _docs(200), _items()[:30] + _items()[300:]
    spark.createDataFrame([(k, t, 1, "x") for k, t in docs], "doc_id long, text string, segment int, term string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = queries.op12_lexical(spark, str(tmp_path))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    got = [tuple(r) for r in got.collect()]
    assert _sorted(got) == _sorted(_expected(docs, items))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert _sorted(con.sql(LEXICAL).fetchall()) == _sorted(got)
