"""What SQL can't express, against plain rules or cases worked by hand."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from threadloom.functions import chunking, cleaning
from threadloom.operators import facts, filters, search, topics
from threadloom.plans import text_queries, upkeep_queries
from threadloom.sources import files
from threadloom.streaming import windows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def test_chunks():
    words = [f"w{k}" for k in range(40)]
    short = "\n\n".join(" ".join(words) for _ in range(3))
    assert chunking.chunked(short) == [short] and chunking.chunked("") == [""]
    paragraph = "x" * 1200
    # a chunk begins with the last paragraph of the one before
    assert chunking.chunked("\n\n".join([paragraph] * 4), 500) == [paragraph, *[f"{paragraph}\n\n{paragraph}"] * 3]
    long = ". ".join("s" * 300 + str(k) for k in range(30))
    chunks = chunking.chunked(long, 500)
    assert all(len(c) // 4 <= 501 for c in chunks) and len(chunks) > 3
    sentences = long.replace(". ", ".\n").split("\n")
    # every sentence is there in order, the last of a chunk again first in the next
    rest = [s for c in chunks for s in c.split()]
    assert [s for k, s in enumerate(rest) if not k or s != rest[k - 1]] == sentences
    blank = " " * 9000
    assert chunking.chunked(blank) == [blank]


def test_chunk_column_and_table_functions(spark):
    text = "\n\n".join("p" * 900 + str(k) for k in range(8))
    df = spark.createDataFrame([(1, text), (2, None), (3, "a")], "id long, text string")
    got = {r["id"]: r["c"] for r in df.select("id", chunking.chunks(F.col("text")).alias("c")).collect()}
    assert got == {1: chunking.chunked(text), 2: None, 3: ["a"]}
    chunking.register(spark)
    df.createOrReplaceTempView("texts")
    rows = spark.sql("SELECT id, t.place, t.chunk FROM texts, LATERAL chunk_text(text) t ORDER BY id, place").collect()
    assert [r["chunk"] for r in rows] == [*chunking.chunked(text), "a"]
    found = spark.sql("SELECT url FROM extract_urls('a https://x.y/z. https://x.y/z http://q')").collect()
    assert [r["url"] for r in found] == ["https://x.y/z", "http://q"]


def test_message_chunks_cover_their_messages(spark):
    rows = text_queries.message_chunks(spark, SF).collect()
    kinds = {r["id"]: set() for r in rows}
    for r in rows:
        kinds[r["id"]].add(r["chunk_type"])
        assert r["chunk_text"].startswith("From: ") and len(r["chunk_text"]) <= 500
    for own in kinds.values():
        assert own == {"message", *(f"message_chunk_{k}" for k in range(1, len(own)))}


def test_main_text():
    body = "word " * 80
    page = f"<title>T</title><nav>menu</nav><script>bad()</script><article><h1>A</h1>{body}</article><footer>foot</footer>"
    assert files.main_text(page) == f"T\n\nA {body.strip()}"
    assert files.main_text(page.replace("<article>", "<div role=main>").replace("</article>", "</div>")) == f"T\n\nA {body.strip()}"
    short = "<title>T</title><nav>menu</nav><article>few</article>"
    assert files.main_text(short) == "T\n\nmenu few"
    script = '<title>T</title><script type="application/json">{"text": "a long told text inside of the page"}</script>'
    assert "a long told text inside of the page" in files.main_text(script)
    assert files.html_to_text("<style>x</style><p>a <b>b</b></p>") == "a b"


def test_archives():
    def zipped(members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in members:
                z.writestr(name, text)
        return out.getvalue()

    got = files.text_of("archive", zipped([("a.txt", "one"), ("../b.txt", "two"), ("/c.txt", "three"), ("d.exe", "four"), ("e/f.csv", "x,y\n1,2")]))
    assert got == "[a.txt]\none\n\n[e/f.csv]\nx,y\n1,2"
    many = files.text_of("archive", zipped([(f"{k}.txt", "z" * 9000) for k in range(30)]))
    assert many.count("[") <= files.MOST_MEMBERS and len(many) <= files.MOST_ARCHIVE + 100
    assert files.text_of("archive", zipped([])) is None and files.text_of("text", b"  ") is None
    assert files.text_of("table", b"\n".join(b"r" for _ in range(900))).count("\n") == files.MOST_LINES - 1


def _halved(x, depth=0, topic="root"):
    """(topic, size, coherence) of the tree over unit vectors, one node after the other."""
    mean = x.mean(0)
    out = [(topic, len(x), round(float(np.linalg.norm(mean)), 9))]
    if depth == topics.DEPTH or len(x) < topics.FEW or np.linalg.norm(mean) > topics.COHERENT:
        return out
    one = x[(x @ mean).argmin()]
    sides = np.stack([one, x[(x @ one).argmin()]])
    for _ in range(topics.ROUNDS):
        own = (x @ sides.T).argmax(1)
        moved = np.stack([x[own == k].mean(0) if (own == k).any() else sides[k] for k in (0, 1)])
        moved /= np.linalg.norm(moved, axis=1, keepdims=True)
        if np.allclose(moved, sides, rtol=0, atol=1e-12):
            break
        sides = moved
    if min((own == 0).sum(), (own == 1).sum()) < topics.LEAST:
        return out
    return out + _halved(x[own == 0], depth + 1, f"{topic}.0") + _halved(x[own == 1], depth + 1, f"{topic}.1")


def test_topic_tree(spark):
    rng = np.random.RandomState(1)
    centres = rng.normal(size=(6, 16))
    x = np.concatenate([c + 0.3 * rng.normal(size=(90, 16)) for c in centres])
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [1.0] * 3), (1003, [None] + [1.0] * 15), (1004, [float("nan")] + [1.0] * 15), (1005, [])]
    df = spark.createDataFrame(rows + odd, "id long, embedding array<double>").repartition(3)
    tree = topics.fit(df)
    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert sorted((n.topic, n.size, round(n.coherence, 9)) for n in tree) == sorted(_halved(units)) and len(tree) > 5
    assert {n.parent for n in tree[1:]} == {n.topic for n in tree if n.halves is not None}
    members = topics.assign(df, tree).collect()
    size = {n.topic: n.size for n in tree}
    assert {t: sum(r["topic"] == t for r in members) for t in size} == size and max(r["id"] for r in members) < 1000
    leaf = {r["topic"] for r in topics.leaves(spark.createDataFrame(members)).collect()}
    assert leaf == {n.topic for n in tree if n.halves is None}
    assert topics.fit(df.limit(20)) == [] and topics.fit(df.where("id > 1000")) == [] and topics.assign(df, []).count() == 0
    assert topics.shard_size(1, 1024) == 85 and topics.shard_size(0, 10) == 1


def test_attachment_filter_without_owner(spark):
    m = spark.createDataFrame([("1", "d"), ("2", "d")], "id string, date string")
    a = spark.createDataFrame([("1",), (None,)], "message_id string")
    assert [r["id"] for r in filters.candidates(m, a, has_attachment=True).collect()] == ["1"]
    assert [r["id"] for r in filters.candidates(m, a, has_attachment=False).collect()] == ["2"]
    assert filters.candidates(m, a).count() == 2


def test_not_in_nulls(spark):
    own = spark.createDataFrame([(1,), (2,), (None,)], "a long")
    other = lambda *v: spark.createDataFrame([(x,) for x in v], "b long")
    assert [r["a"] for r in filters.not_in(own, "a", other(2, 3), "b").collect()] == [1]
    assert filters.not_in(own, "a", other(2, None), "b").count() == 0
    assert filters.not_in(own, "a", other(), "b").count() == 3


def test_fact_values():
    assert facts.conflicting("bought in 2022", "bought in 2024") and not facts.conflicting("plate 7ABC123", "7abc123 is the plate")
    assert facts.fact_terms("what cars do I own") == ["cars", "car"]


def test_search_tokens():
    assert cleaning.search_tokens("foo AND (bar) 'baz'- \"qu*x\" NOT") == ["foo", "bar", "baz", "qu", "x"]
    assert cleaning.search_tokens(None) == [] and len(cleaning.search_tokens("w " * 100)) == 32 and cleaning.search_tokens("y" * 90) == ["y" * 64]
    assert cleaning.expanded("hoa dues", {"hoa": ["home owners", "x", "y"]}) == "hoa home owners x dues"
    assert cleaning.temporal_boost("latest notes from today") == 0.35


def test_reindex_triggers_count_everything(spark):
    got = {r["event_type"]: r for r in upkeep_queries.reindex_triggered(spark, SF).collect()}
    counts = {r["event_type"]: r["count"] for r in spark.read.parquet(f"{SF}/events.parquet").groupBy("event_type").count().collect()}
    assert {k for k, n in counts.items() if n >= 150} == set(got)
    assert all(r["n"] == counts[k] and r["reason"] == "count" for k, r in got.items())


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    """A second run over a folder with one more file handles that file alone."""
    at, source = str(tmp_path / "state"), str(tmp_path / "in")
    for k in (1, 2):
        spark.range(10 * k, 10 * k + 5).write.mode("append").parquet(source)
        got = windows.drained(spark.readStream.schema("id long").parquet(source), at)
        assert sorted(r["id"] for r in got.collect()) == [x for j in range(1, k + 1) for x in range(10 * j, 10 * j + 5)]
