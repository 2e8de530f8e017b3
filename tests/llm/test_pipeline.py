"""The pipeline's stages on small tables."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

import corpus_pipeline


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_language_keeps_short_documents(spark):
    """Only null texts and texts without a letter go, however low the best score is."""
    rng = random.Random(3)
    letters = {"one": "bcdfg", "two": "hijkl", "three": "mnopq", "four": "rstuv"}
    rows = [(k, " a ".join("".join(rng.choice(own) for _ in range(4)) for _ in range(20)), lang, "s", 1) for k, (lang, own) in enumerate([*letters.items()] * 20)]
    short = [(100, "A.", "one", "s", 1), (101, "a a A!!", None, "s", 1), (102, "\u5b57", "two", "s", 1), (None, "A", "four", "s", 1)]
    none = [(110, None, "one", "s", 1), (111, "", "two", "s", 1), (112, "12 !!", None, "s", 1)]
    docs = spark.createDataFrame([*rows, *short, *none], SCHEMA)
    got = corpus_pipeline.language(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [*rows, *short]))
    assert corpus_pipeline.language(spark, docs.limit(0), "").count() == 0


def _near(rows):
    """The rows that should stay, by brute force over all pairs."""
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset() for _, t, *_ in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])) or rows[a][:2] == rows[b][:2]:
                    group[a] = group[b] = min(group[a], group[b])
    return [[rows[k] for k in range(len(rows)) if group[k] == g] for g in sorted(set(group))]


def test_near_duplicates_by_row(spark):
    """One row of each group stays, also where ids are repeated or null."""
    base, other, third = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    texts = [(1, base), (2, base + " end"), (2, "a text of its own under the same id"), (3, other), (3, other + " end"), (None, third), (None, third), (None, third + " end"), (None, base), (4, "one two"), (4, "one two"), (5, None), (6, ""), (5, None), (7, "zebra"), (8, "ZEBRA")]
    rows = [(i, t, "en", "s", 1) for i, t in texts]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    out = [tuple(r) for r in got.collect()]
    for group in _near(rows):
        stay = [r for r in out if r in group]
        assert len(stay) == 1, (group, stay)
        assert stay[0][0] == min((r[0] for r in group if r[0] is not None), default=None)
    assert len(out) == len(_near(rows))
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_near_duplicates_of_rows_that_clash(spark):
    docs = spark.createDataFrame([(1, "x y z", 0), (2, "x y z", 1), (3, "q", 2)], "doc_id long, text string, __row long")
    assert sorted(tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [(1, "x y z", 0), (3, "q", 2)]


def test_mix_takes_any_column_names(spark):
    """Columns named as the mix's own are data; copies follow the targets."""
    rows = [(k, "w " * (1 + k % 5), "a" if k % 3 else None, 7.0, "x", 5) for k in range(400)] + [(1, "w w", "a", 7.0, "x", 5)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target double, copies string, source_size long")
    got = corpus_pipeline.mix(spark, docs, "")
    assert got.columns == docs.columns
    taken, size = {}, {}
    for r in got.collect():
        assert tuple(r)[3:] == (7.0, "x", 5)
        taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].split())
    for r in rows:
        size[r[2]] = size.get(r[2], 0) + len(r[1].split())
    # two sources of weights 5 and 2 share 150 %, none above twice its size
    total = 1.5 * sum(size.values())
    want = {"a": min(2 * size["a"], total * 5 / 7)}
    want[None] = min(2 * size[None], total - want["a"])
    assert all(abs(taken[s] - want[s]) < 0.05 * want[s] for s in want)
    assert corpus_pipeline.mix(spark, docs.limit(0), "").count() == 0


def test_tokens_by_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame([(1, "Some text.", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (1, "Some text.", "en", "s", 1)], SCHEMA)
    for r in corpus_pipeline.tokens(spark, docs, "").collect():
        text = {1: "Some text.", 2: "", 3: ""}[r["doc_id"]]
        assert r["ids"] == library.encode(text, add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


def test_run_on_a_small_table(spark, tmp_path):
    """All stages on nulls, copies, repeated ids and a clashing column: what comes out is what the stages' rules leave."""
    rng = random.Random(9)
    letters = {"one": "bcdfg", "two": "hijkl"}
    rows = [(k, " ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(30)), lang, f"s{k % 2}", 1, 1.5) for k, lang in enumerate(["one", "two"] * 30)]
    rows += [(100 + k, rows[k][1] + " end", "one", "s0", 1, 1.5) for k in range(5)] + [(3, "another text under a taken id here", "one", "s1", 1, 1.5)]
    rows += [(200, None, "one", "s0", 1, 1.5), (201, "12 34", "one", "s0", 1, 1.5), (None, rows[7][1], "two", None, 1, 1.5)]
    docs = spark.createDataFrame(rows, f"{SCHEMA}, target double")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(out.columns) == {"doc_id", "lang", "source", "n_tokens", "ids"}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coded = {tuple(library.encode(t, add_special_tokens=False).ids): (i, t) for i, t, *_ in reversed(rows) if t}
    seen = set()
    for r in out.collect():
        i, t = coded[tuple(r["ids"])]
        assert r["doc_id"] == i
        seen.add((i, t))
    stay = {(i, t) for i, t, *_ in rows if t and t != "12 34" and not t.endswith(" end") and i is not None}
    assert seen <= stay and len(seen) >= 0.7 * len(stay)
