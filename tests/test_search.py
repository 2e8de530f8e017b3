"""The word index against counting words, and the steps of a search."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from threadloom.operators import engine, search
from threadloom.sources.word_index import WordIndex


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


SCHEMA = "id long, a string, b string"


def _expected(docs, terms, fields=(1, 2)):
    """{id: (any, phrase)} by counting."""
    out = {}
    for f in fields:
        split = {d[0]: re.findall(r"\w+", (d[f] or "").lower()) for d in docs}
        mean = sum(map(len, split.values())) / len(split)
        idf = {t: math.log(1 + (len(split) - (df := sum(t in w for w in split.values())) + 0.5) / (df + 0.5)) for t in terms}
        for i, w in split.items():
            part = lambda tf, n=len(w), m=mean: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / m)) if tf else 0
            said = sum(idf[t] * part(Counter(w)[t]) for t in terms)
            row = sum(w[k : k + len(terms)] == terms for k in range(len(w))) if len(terms) > 1 else 0
            old = out.get(i, (0, 0))
            out[i] = (old[0] + said, old[1] + sum(idf.values()) * part(row))
    return {i: tuple(round(x, 9) for x in v) for i, v in out.items() if v[0] > 0}


def _got(index, terms):
    return {r["id"]: (round(r["any"], 9), round(r["phrase"], 9)) for r in index.scores(terms).collect()}


DOCS = [(1, "Draw request now", "the draw request, draw request"), (2, "request to draw", None), (3, None, "nothing"), (4, "", "DRAW draw draw"), (5, "été straße", "a_b c1"), (6, "request", "draw")]


def test_segments_and_deletions(spark, tmp_path):
    index = WordIndex(spark, str(tmp_path / "i"), ["a", "b"], buckets=4)
    assert _got(index, ["draw"]) == {}
    table = lambda rows: spark.createDataFrame(rows, SCHEMA)
    index.add(table(DOCS[:3]), "id")
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "i/postings").rglob("*.parquet")}
    index.add(table(DOCS[3:]), "id")
    for terms in (["draw"], ["draw", "request"], ["request", "draw", "nowhere"], ["été"], ["a_b", "c1"], ["nowhere"]):
        assert _got(index, terms) == _expected(DOCS, terms), terms
    index.delete(table([(2, "", ""), (99, "", "")]), "id")
    index.delete(table([(2, "", "")]), "id")
    left = [d for d in DOCS if d[0] != 2]
    assert _got(index, ["draw", "request"]) == _expected(left, ["draw", "request"])
    index.add(table([(2, "draw request draw request", "x")]), "id")
    assert _got(index, ["draw", "request"]) == _expected([*left, (2, "draw request draw request", "x")], ["draw", "request"])
    assert {p: p.stat().st_mtime_ns for p in files} == files


def test_reads_only_its_terms(spark, tmp_path):
    index = WordIndex(spark, str(tmp_path / "i"), ["a", "b"], buckets=8)
    index.add(spark.createDataFrame(DOCS, SCHEMA), "id")
    found = index.postings(["draw"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,draw)]" in plan
    buckets = {re.search(r"bucket=(\d+)", f)[1] for f in found.inputFiles()}
    assert len(buckets) == 1


def test_steps(spark, tmp_path):
    rows = [(str(k), f"t{k // 2}", "u", f"s{k % 3} <s{k % 3}@x>", f"Draw {k}", f"draw request {'now ' * k}" if k % 2 else "other text", f"2024-01-{k + 1:02}T00:00:00+00:00", ["INBOX"]) for k in range(12)]
    m = spark.createDataFrame(rows, "id string, thread_id string, user_id string, from_addr string, subject string, body_text string, date string, labels array<string>")
    v = spark.createDataFrame([(str(k), [math.cos(k), math.sin(k)]) for k in range(6)], "message_id string, embedding array<double>")
    index = WordIndex(spark, str(tmp_path / "i"), ["body_text"], kind="string")
    index.add(m, "id")
    box = engine.Mailbox(m, v, index)
    ask = lambda text, **more: engine.Question(text, [1.0, 0.0], as_of="2024-02-01T00:00:00Z", **more)
    both = {r["id"]: r["bm25"] for r in engine.word_scores(index, ask("nix", aliases={"nix": ["request"]})).collect()}
    assert set(both) == {str(k) for k in range(1, 12, 2)} and max(both.values()) == 1.0 and min(both.values()) == 0.0
    only = m.where("id in ('1', '4')")
    assert {r["id"] for r in engine.matches(box, ask("draw", candidates=only)).collect()} == {"1", "4"}
    plain, fresh = ({r["thread_id"]: r["score"] for r in engine.blended(box, ask(q)).collect()} for q in ("request", "latest request"))
    assert set(plain) == set(fresh) and fresh["t5"] - plain["t5"] > fresh["t1"] - plain["t1"]
    shown = engine.ranked(box, ask("request"), top=4).collect()
    assert [r["place"] for r in shown] == list(range(1, len(shown) + 1)) and [r["score"] for r in shown] == sorted((r["score"] for r in shown), reverse=True)
    again = lambda found: found.select("thread_id", (-F.col("score")).alias("place")).orderBy("score").limit(2)
    assert {r["thread_id"] for r in engine.ranked(box, ask("request"), top=4, rerank=again).collect()} == {r["thread_id"] for r in shown}
    assert engine.ranked(box, ask("nowhere at all", candidates=m.where("false"))).count() == 0


def test_text_search_phrase(spark, tmp_path):
    m = spark.createDataFrame([("1", "draw request", "a", "b", "x"), ("2", "request to draw", "a", "b", "x"), ("3", "none", "a", "b", "x"), ("4", None, "a", "b", None)], "id string, subject string, from_addr string, to_addr string, body_text string")
    a = spark.createDataFrame([(9, "3", "file", "the draw is here"), (10, "4", None, None)], "id long, message_id string, filename string, extracted_text string")
    own, held = WordIndex(spark, str(tmp_path / "m"), search.MESSAGE_FIELDS, "string"), WordIndex(spark, str(tmp_path / "a"), search.ATTACHMENT_FIELDS)
    own.add(m, "id"), held.add(a, "id")
    got = {r["id"]: r["score"] for r in search.text_search(own, held, a, ["draw", "request"]).collect()}
    assert set(got) == {"1", "2", "3"} and got["1"] == 1.0 and got["1"] > got["2"]
