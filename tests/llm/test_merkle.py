"""The manifest against trees built by hand, and its SQL."""

from __future__ import annotations

import hashlib
import zlib
from pathlib import Path

import duckdb
import pytest

from threadloom.llm import queries
from threadloom.llm.oracles import MERKLE

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, hash string, tree int"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def _tree(hashes):
    """(root, a list of (side, sibling) or None for each leaf)."""
    paths, owners = [[] for _ in hashes], [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        pairs = [range(i, min(i + 2, len(hashes))) for i in range(0, len(hashes), 2)]
        for pair in pairs:
            for me in pair:
                step = next((("L" if other < me else "R", hashes[other]) for other in pair if other != me), None)
                for leaf in owners[me]:
                    paths[leaf].append(step)
        hashes, owners = [_h(*(hashes[i] for i in p)) for p in pairs], [sum((owners[i] for i in p), []) for p in pairs]
    return hashes[0], paths


def _expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    trees = []
    for lang in sorted(groups, key=lambda x: (x is not None, (x or "").encode())):
        members = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        trees.append((members, *_tree([_leaf(r) for r in members])))
    root, upper = _tree([t[1] for t in trees]) if trees else (None, [])
    out = []
    for (members, subroot, paths), above in zip(trees, upper, strict=True):
        for r, path in zip(members, paths, strict=True):
            own = r
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                own = (*r[:3], r[3] + 1, r[4])
            h = _leaf(own)
            for step in path + above:
                h = _h(h) if step is None else _h(step[1], h) if step[0] == "L" else _h(h, step[1])
            out.append((r[0], _leaf(r), subroot, root, _h(*(s[1] for s in path + above if s)), h, h == root))
    return out


def _sorted(rows):
    return sorted(rows, key=lambda r: (str(r[0]), *r[1:]))


def _table(n):
    langs = ["a", "é", None, "b", "", "B"]
    rows = [(i % 40 if i % 11 else None, None if i % 5 == 0 else "s", langs[i % 7 % 6], None if i % 3 == 0 else i, None if i % 7 == 0 else "ü" * i, "h", 1) for i in range(n)]
    return rows + rows[:5] + [(10**12, "s", "long", 7, "word " * 200_000, "h", 2)] if n > 5 else rows


@pytest.mark.parametrize("n", [0, 1, 3, 300])
def test_merkle(spark, tmp_path, n):
    rows = _table(n)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_merkle(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = [tuple(r) for r in got.collect()]
    assert _sorted(got) == _sorted(_expected(rows))
    assert all(r[6] for r in got if r[0] is None)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{Path(tmp_path)}/documents.parquet/*.parquet'")
    assert _sorted(con.sql(MERKLE).fetchall()) == _sorted(got)
