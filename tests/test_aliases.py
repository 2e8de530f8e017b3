"""Alias pairs of frequent words."""

from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from threadloom.plans import fact_queries


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def test_frequent_words_pair(spark, tmp_path):
    """Words of more than 12 texts pair as rare ones do."""
    texts = ["Red fox" if k < 30 else "red" if k < 40 else "blue sky" if k < 42 else "sky" for k in range(60)]
    rows = [*enumerate(texts), (7, "fox owl"), (60, "owl"), (61, None), (62, "")]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sets: dict[str, set] = {}
    for k, text in rows:
        for w in (text or "").lower().split():
            sets.setdefault(w, set()).add(k)
    want = set()
    for a in sets:
        for b in sets:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and min(len(sets[a]), len(sets[b])) >= 2 and both / either >= 0.25:
                want.add((a, b, both, round(both / either, 6)))
    assert ("fox", "red", 30, 0.75) in want
    assert {tuple(r) for r in fact_queries.alias_cooccurrence_all(spark, str(tmp_path)).collect()} == want
