"""Every registered query of this subpackage over one small folder of tables, against what its contract says."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.test_operators import SCHEMA, _nearest_hits, _rows, _vectors, _words
from threadloom.llm import queries

BPE = public_tokenizers.path("byte_bpe_50k.json")
PAGES = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://b", None), (4, "u", ""), (5, "w", "é" * 900)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(_rows(), SCHEMA).repartition(3).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{home}/pages.parquet")
    spark.createDataFrame(_vectors(), "vec_id long, embedding array<double>, label int").write.parquet(f"{home}/embeddings.parquet")
    return str(home)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{home}/pages.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<double>, label int").write.parquet(f"{home}/embeddings.parquet")
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    return str(home)


def _fold(key, n):
    return zlib.crc32(str("" if key is None else key).encode()) % n


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_op2(spark, folder):
    got = queries.op2_language_id(spark, folder).collect()
    texts = defaultdict(set)
    for r in _rows():
        texts[r[0]].add(r[1])
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in _rows())
    for r in got:
        none = all(not re.search(r"[^\W\d_]", t or "") for t in texts[r["doc_id"]])
        assert r["held_out"] == (r["doc_id"] is not None and _fold(r["doc_id"], 4) == 2) or r["doc_id"] is None
        assert (r["lang_pred"] == "und") == none and 0 <= r["score"] <= 1 and r["lang_pred"] in ("und", "en", "de")


def test_op3(spark, folder):
    library = Tokenizer.from_file(BPE)
    want = Counter()
    for key, text, *_ in _rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[(key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op3_bpe(spark, folder).collect()) == want


def test_op4(spark, folder):
    sets = defaultdict(list)
    for key, text, *_ in _rows():
        w = _words(text)
        sets[key].append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    own = [(k, s) for k, all_ in sets.items() if k is not None for s in all_]
    near = defaultdict(set)
    for a, x in own:
        for b, y in own:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                near[a].add(b)
    for r in queries.op4_jaccard_join(spark, folder).where("doc_id IS NOT NULL").collect():
        seen, todo = {r["doc_id"]}, [r["doc_id"]]
        while todo:
            todo += [b for b in near[todo.pop()] if b not in seen and not seen.add(b)]
        assert r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]} and r["component_id"] == min(seen)


def test_op5(spark, folder):
    digest = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    want = set()
    for page, _, text in PAGES:
        text = text or ""
        last = max(p for p, _, t in PAGES if (t or "") == text)
        want.add((page, len(text.encode()), digest(text), "response" if page == last else "revisit", None if page == last else last))
    assert {tuple(r) for r in queries.op5_warc(spark, folder).collect()} == want


def test_op6(spark, folder):
    library, start = Tokenizer.from_file(BPE), 0
    got = sorted(queries.op6_token_bin(spark, folder).collect(), key=lambda r: r["start"])
    keys = [r["doc_id"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k)) and Counter(keys) == Counter(r[0] for r in _rows())
    texts = defaultdict(Counter)
    for key, text, *_ in _rows():
        texts[key][zlib.crc32(np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes())] += 1
    found = defaultdict(Counter)
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
        found[r["doc_id"]][r["ids_crc32"]] += 1
    assert found == texts


def test_op7(spark, folder):
    got = queries.op7_mixing(spark, folder).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((k, len(_words(t))) for k, t, *_ in _rows())
    assert all(r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] for r in got)
    again = queries.op7_mixing(spark, folder).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_op8(spark, folder):
    got = queries.op8_lm_scoring(spark, folder).collect()
    assert all(r["held_out"] == (_fold(r["doc_id"], 7) == 2) for r in got if r["doc_id"] is not None)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((k, len(_words(t)) + 1) for k, t, *_ in _rows())
    assert all(math.isfinite(r["score"]) and r["score"] < 0 and r["n_known"] <= r["n_tokens"] for r in got)


def test_op9(spark, folder):
    got = queries.op9_vector_dedup(spark, folder).collect()
    assert Counter(r["vec_id"] for r in got) == Counter(r[0] for r in _vectors())
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got) and any(r["n_links"] > 5 for r in got)
    assert all(r["n_links"] == 0 and r["kept"] for r in got if r["vec_id"] in (302, 303, 304, 305, 306, 309))


def test_op10(spark, folder):
    rows = _vectors()
    hits, total = _nearest_hits(rows, queries.op10_nearest(spark, folder).collect())
    assert hits >= 0.95 * total > 0
