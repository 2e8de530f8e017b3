"""Ranked lexical search: an index of segments with a max tree over document ranges for each term.

``build`` deals documents into segments of at most ``DOCS`` documents, in the tasks that
read them and without a shuffle, and writes one row for each term of a segment: documents,
frequencies, and for each leaf (a range of ``LEAF`` documents) a bound of the frequency from
above and of the document length from below.  The bounds hold whatever the collection's
totals are, so segments can be added without touching old ones.

``search`` takes totals and document frequencies from the index, reads the query terms'
rows, and walks each segment's tree best first: a node's bound is the sum of its terms'
bounds, the highest is opened first, and nodes whose bound equals the k-th score are opened
too, as a smaller id may stand there.  Queries go in blocks; a task holds one segment's rows
for one block.  Scores are 64-bit integers, so results are exact.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII; only A-Z are
lower-cased.  Null and empty texts have no terms and aren't counted.  Equal scores are ordered
by key, null keys last; rows with equal keys are documents of their own.  Queries repeated in
id and text are one query; equal ids with other texts are separate lists.  Queries without
terms, and empty tables, give no rows.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm.shared import cut, shared_dir, small_batches
from threadloom.llm.words import buffers

#: Documents and terms (with repeats) at which a segment closes.
DOCS, TERMS = 4096, 4_000_000
LEAF, FANOUT = 64, 8
#: Characters of a very long text that are taken at once.
PIECE = 1 << 20
#: Queries of a block.
BLOCK = 256
#: The formula's fixed values: scale of a term's weight, of saturation, and its two constants.
SCALE, UNIT, STEP, HALF = 1000, 1_000_000_000, 20, 50

_TERM, _GAP = re.compile(rb"[0-9A-Za-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_INDEX = "segment long, term string, df int, places binary, tfs binary, leaves binary, tops binary, keys binary, known binary, lengths binary, docs long, words long"
_FIELDS = pa.schema([("segment", pa.int64()), ("term", pa.string()), ("df", pa.int32()), *((c, pa.binary()) for c in ("places", "tfs", "leaves", "tops", "keys", "known", "lengths")), ("docs", pa.int64()), ("words", pa.int64())])


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, a bounded piece at a time."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        yield _TERM.findall(text[at:end].lower())
        at = end


class _Segment:
    """The documents of a segment that is being filled."""

    def __init__(self, number: int):
        self.number, self.keys, self.lengths, self.ids, self.terms = number, [], [], [], 0
        self.vocabulary: defaultdict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__

    def add(self, key: int | None, text: bytes) -> None:
        n, number = 0, self.vocabulary.__getitem__
        for piece in terms_of(text):
            n += len(piece)
            self.ids.append(np.fromiter(map(number, piece), np.int64, len(piece)) * DOCS + len(self.keys))
        self.keys.append(key)
        self.lengths.append(n)
        self.terms += n

    def rows(self) -> Iterator[pa.RecordBatch]:
        lengths = np.array(self.lengths, np.uint32)
        head = {
            "segment": self.number, "keys": np.array([k or 0 for k in self.keys], np.int64).tobytes(), "known": np.array([k is not None for k in self.keys]).tobytes(),
            "lengths": lengths.tobytes(), "docs": int((lengths > 0).sum()), "words": int(lengths.sum(dtype=np.int64)),
        }
        yield pa.RecordBatch.from_pylist([head], schema=_FIELDS)
        if not self.terms:
            return
        pairs, tf = np.unique(np.concatenate(self.ids), return_counts=True)
        term, place = pairs // DOCS, (pairs % DOCS).astype(np.uint16)
        names = pa.array(list(self.vocabulary), pa.binary()).cast(pa.string())
        starts = np.searchsorted(term, np.arange(len(names) + 1))
        leaf = term * (DOCS // LEAF) + place // LEAF
        at = np.flatnonzero(np.diff(leaf, prepend=-1))
        top = np.stack([np.minimum(np.maximum.reduceat(tf, at), 255), _length_class(np.minimum.reduceat(lengths[place], at))], axis=1).astype(np.uint8)
        leaf_starts = np.searchsorted(at, starts)
        leaves = (leaf[at] % (DOCS // LEAF)).astype(np.uint8)
        for a in range(0, len(names), 8192):
            b = min(len(names), a + 8192)
            posts, tops = starts[a : b + 1], leaf_starts[a : b + 1]
            tfs = [tf[i:j].astype(np.uint8 if tf[i:j].max() < 256 else np.uint32).tobytes() for i, j in zip(posts, posts[1:])]
            none = pa.nulls(b - a, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(b - a, self.number)), names[a:b], pa.array(np.diff(posts).astype(np.int32)), _slices(place, posts), pa.array(tfs, pa.binary()),
                    _slices(leaves, tops), _slices(top, tops), none, none, none, pa.nulls(b - a, pa.int64()), pa.nulls(b - a, pa.int64()),
                ],
                schema=_FIELDS,
            )


def _slices(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The bytes of consecutive runs of ``values``."""
    width = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    offsets = ((starts - starts[0]) * width).astype(np.int32)
    data = np.ascontiguousarray(values[starts[0] : starts[-1]]).tobytes()
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def _length_class(n: np.ndarray) -> np.ndarray:
    """Eighths of a doubling, rounded down."""
    return np.minimum(np.log2(np.maximum(n, 1).astype(np.float64)) * 8, 255).astype(np.uint8)


#: The least length of each class; never above a member.
_LEAST = np.floor(np.exp2(np.arange(256) / 8 - 1e-9)).astype(np.float64)


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of ``docs``, written to the shared folder."""
    small_batches(docs.sparkSession)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        now = _Segment(number)
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            data = memoryview(data)
            for i, k in enumerate(batch.column(0).to_pylist()):
                now.add(k, bytes(data[offsets[i] : offsets[i + 1]]))
                if len(now.keys) >= DOCS or now.terms >= TERMS:
                    yield from now.rows()
                    number += 1
                    now = _Segment(number)
        if now.keys:
            yield from now.rows()

    path = shared_dir(docs.sparkSession, "lexical")
    docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(segments, _INDEX).write.parquet(path)
    return docs.sparkSession.read.schema(_INDEX).parquet(path)


def search(index: DataFrame, queries: DataFrame, k: int, query_id: str = "item_id", text: str = "text", key: str = "doc_id") -> DataFrame:
    """(query_id, rank, key, score) of the ``k`` best documents of each row of ``queries``; driver: one row per ``BLOCK`` queries."""
    asked = cut(queries.select(F.col(query_id).alias("name"), F.col(text).alias("text")).distinct().withColumn("query", F.monotonically_increasing_id()))
    terms = cut(asked.mapInArrow(_query_terms, "term string, query long"))
    total = index.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    docs, words = total["docs"] or 0, total["words"] or 0
    weighed = index.where("term IS NOT NULL").join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(SCALE * F.log((2 * docs + 2) / (2 * F.col("df") + 1))).cast("long")
    in_block = terms.groupBy("term", F.shiftright("query", 8).alias("block")).agg(F.collect_list((F.col("query") % BLOCK).cast("int")).alias("queries"))
    in_block = cut(in_block.join(weighed.select("term", weight.alias("weight")), "term"))
    blocks = [r[0] for r in in_block.select("block").distinct().collect()]
    lists = index.where("term IS NOT NULL").join(in_block, "term").select("segment", "block", "weight", "queries", "places", "tfs", "leaves", "tops", "keys", "known", "lengths")
    heads = index.where("term IS NULL").select(
        "segment", F.explode(F.array(*map(F.lit, blocks)).cast("array<long>")).alias("block"), F.lit(None).cast("long").alias("weight"), F.lit(None).cast("array<int>").alias("queries"),
        "places", "tfs", "leaves", "tops", "keys", "known", "lengths",
    )

    def best(table: pa.Table) -> pa.Table:
        return _search_segment(table, docs, words, k)

    found = lists.unionByName(heads).groupBy("segment", "block").applyInArrow(best, "query long, doc long, score long")
    order = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("query", "name"), "query").select(F.col("name").alias(query_id), "rank", F.col("doc").alias(key), "score")


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, query in zip(batch.column("text").to_pylist(), batch.column("query").to_pylist(), strict=True):
            found = sorted({t for piece in terms_of((text or "").encode()) for t in piece})
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()).cast(pa.string()), pa.array([query] * len(found), pa.int64())], ["term", "query"])


def _saturated(tf: np.ndarray, damp: np.ndarray) -> np.ndarray:
    return (UNIT * tf) // (SCALE * tf + STEP * damp)


def _search_segment(table: pa.Table, docs: int, words: int, k: int) -> pa.Table:
    """The ``k`` best documents of one segment for each query of a block."""
    rows = table.to_pylist()
    head = next(r for r in rows if r["weight"] is None)
    rows = [r for r in rows if r["weight"]]
    keys, known, lengths = np.frombuffer(head["keys"], np.int64), np.frombuffer(head["known"], bool), np.frombuffer(head["lengths"], np.uint32).astype(np.int64)
    damp = 100 - HALF + (HALF * lengths * docs) // max(words, 1)
    leaves = DOCS // LEAF
    bounds = np.zeros((len(rows), leaves), np.int64)
    asked: dict[int, list[int]] = defaultdict(list)
    for i, r in enumerate(rows):
        top = np.frombuffer(r["tops"], np.uint8).reshape(-1, 2)
        most = _saturated(top[:, 0].astype(np.int64), 100 - HALF + (HALF * _LEAST[top[:, 1]].astype(np.int64) * docs) // max(words, 1))
        most[top[:, 0] == 255] = UNIT // SCALE
        bounds[i, np.frombuffer(r["leaves"], np.uint8)] = most * r["weight"]
        for q in r["queries"]:
            asked[q].append(i)
    wide = bounds.reshape(len(rows), leaves // FANOUT, FANOUT).max(axis=2)
    scored: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def postings(i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, scores, starts of leaves) of a row, made when a first leaf is opened."""
        if i not in scored:
            r = rows[i]
            place = np.frombuffer(r["places"], np.uint16).astype(np.int64)
            tf = np.frombuffer(r["tfs"], np.uint8 if len(r["tfs"]) == len(place) else np.uint32).astype(np.int64)
            scored[i] = place, r["weight"] * _saturated(tf, damp[place]), np.searchsorted(place, np.arange(leaves + 1) * LEAF)
        return scored[i]

    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    base = int(head["block"]) * BLOCK
    for q, own in asked.items():
        own = np.array(own)
        leaf_bound, wide_bound = bounds[own].sum(axis=0), wide[own].sum(axis=0)
        queue = [(-int(bounds[own].max(axis=1).sum()), 0, 0)]
        place, score, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
        while queue and -queue[0][0] >= least:
            _, depth, node = heapq.heappop(queue)
            if depth < 2:
                below = range(len(wide_bound)) if depth == 0 else range(node * FANOUT, (node + 1) * FANOUT)
                bound = wide_bound if depth == 0 else leaf_bound
                for child in below:
                    if bound[child] >= least:
                        heapq.heappush(queue, (-int(bound[child]), depth + 1, child))
                continue
            sums = np.zeros(LEAF, np.int64)
            for i in own[bounds[own, node] > 0]:
                at, points, starts = postings(int(i))
                a, b = starts[node], starts[node + 1]
                sums[at[a:b] - node * LEAF] += points[a:b]
            hit = np.flatnonzero(sums >= least)
            place, score = np.concatenate([place, hit + node * LEAF]), np.concatenate([score, sums[hit]])
            if len(place) > k:
                first = np.lexsort((keys[place], ~known[place], -score))[:k]
                place, score = place[first], score[first]
            if len(place) == k:
                least = max(1, int(score.min()))
        out.append((np.full(len(place), base + q), place, score))
    query, place, score = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    return pa.table({"query": pa.array(query, pa.int64()), "doc": pa.array(keys[place], pa.int64(), mask=~known[place]), "score": pa.array(score, pa.int64())})
