"""Nearest neighbours by inner product: an inverted file with product-quantised residuals.

Coarse centroids and residual codebooks are fitted to a bounded sample; every vector
is then put in its nearest centroid's list as 16 one-byte codes beside the original.
A query visits the lists whose centroids it likes best.  Asymmetric tables (query
part times codeword) rank a list's vectors, the best are ranked again by the exact
product in double precision, and a query's lists are merged.  How many lists to
visit is measured on the sample, where exact neighbours are known.

Lists longer than a block are salted.  A block's vectors come before the queries that
visit it, so a task holds one block and lets any number of queries pass by, and no
vector is copied for them.  Ties go to the smaller id.  Null, zero or non-finite vectors
and null ids take no part; vectors of different lengths are searched apart, each length
with an index of its own; fewer candidates than ``k`` are all returned; rows that
repeat the query's id are not its candidates.  Query rows of equal id and vector are one
query, rows of equal id and other vectors are searched each for itself, so ranks of that id come again
(told apart by nothing, as the id is all that is asked for).  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm.shared import cut
from threadloom.llm.vec_dedup import matrix

#: Vectors the index may be fitted to, the least number of lists, parts of a vector, recall sought on the sample.
SAMPLE = 20_000
LISTS = 64
PARTS = 16
RECALL = 0.98
#: Vectors of a list block, queries ranked at once, the least number of a block's vectors that are ranked exactly.
LIST_BLOCK = 4096
QUERIES = 64
DEPTH = 160
#: Vectors within so many standard errors of the k-th guess are ranked exactly too.
MARGIN = 3.0


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    k = min(k, len(x))
    rng = np.random.RandomState(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        n = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        has = np.flatnonzero(n)
        c[has] = np.add.reduceat(x[order], (np.cumsum(n) - n)[has], axis=0) / n[has, None]
        lack = np.flatnonzero(n == 0)
        c[lack] = x[rng.choice(len(x), len(lack))]
    return c


class Index:
    """Centroids, codebooks (part, codeword, component) and the number of lists to visit."""

    def __init__(self, x: np.ndarray, total: int, k: int):
        dim = x.shape[1]
        x = x.astype(np.float32)
        self.dim = dim
        self.edges = np.linspace(0, dim, min(PARTS, dim) + 1).astype(int)
        self.centroids = kmeans(x, max(LISTS, int(np.sqrt(total) / 8)))
        own = self.nearest(x)
        rest = x - self.centroids[own]
        self.books = [kmeans(rest[:, a:b], 256, seed=5 + a) for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)]
        self.probes = self._probes(x, own, k) if total > 2 * LISTS * k else len(self.centroids)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centroids.T - 0.5 * (self.centroids**2).sum(1)).argmax(1)

    def codes(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        rest = x - self.centroids[own]
        parts = zip(self.edges[:-1], self.edges[1:], self.books, strict=True)
        return np.stack([(rest[:, a:b] @ c.T - 0.5 * (c * c).sum(1)).argmax(1) for a, b, c in parts], axis=1).astype(np.uint8)

    def order(self, q: np.ndarray) -> np.ndarray:
        return np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")

    def _probes(self, x: np.ndarray, own: np.ndarray, k: int) -> int:
        """Lists that hold the sought share of the sample's exact neighbours."""
        q = np.random.RandomState(9).choice(len(x), min(400, len(x)), replace=False)
        s = x[q] @ x.T
        s[np.arange(len(q)), q] = -np.inf
        top = np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, :k]
        place = np.empty((len(q), len(self.centroids)), np.int64)
        np.put_along_axis(place, self.order(x[q]), np.arange(len(self.centroids))[None, :], axis=1)
        ranks = np.sort(np.take_along_axis(place, own[top], axis=1).ravel())
        return int(ranks[min(len(ranks) - 1, int(np.ceil(RECALL * len(ranks))))]) + 1


_FOUND = ["query_id", "row", "vec_id", "score"]


class _Block:
    """The vectors of a list's block by id, their codes, and how far the codes may mislead."""

    def __init__(self, index: Index, of: int, parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts).combine_chunks()
        self.index = index
        self.ids = table.column("id").to_numpy()
        self.x, _ = matrix(table.column("vector").combine_chunks(), index.dim)
        self.codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(len(self.ids), -1)
        # what the codes leave out moves a product by about its length over the root of the dimension
        coded = index.centroids[of] + np.concatenate([c[self.codes[:, m]] for m, c in enumerate(index.books)], axis=1)
        self.margin = MARGIN * np.sqrt(((self.x - coded) ** 2).sum(1).mean() / index.dim)

    def best(self, asker: np.ndarray, q_all: np.ndarray, k: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, vector, score) of the ``k`` best in the block of each query."""
        index, ids = self.index, self.ids
        out, take = [], min(depth, len(ids))
        q = q_all.astype(np.float32)
        guess = np.zeros((len(q), len(ids)), np.float32)
        for m, (a, b) in enumerate(zip(index.edges[:-1], index.edges[1:], strict=True)):
            guess += (q[:, a:b] @ index.books[m].T)[:, self.codes[:, m]]
        guess[asker[:, None] == ids[None, :]] = -np.inf
        least = -np.partition(-guess, take - 1, axis=1)[:, take - 1]
        sure = guess > least[:, None]
        tie = guess == least[:, None]
        chosen = sure | tie & (np.cumsum(tie, axis=1) <= (take - sure.sum(1))[:, None])
        # and all that could yet be among the k best, however many they are
        edge = -np.partition(-guess, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
        chosen |= guess >= (edge - self.margin * np.sqrt((q * q).sum(1)))[:, None]
        for r in range(len(q)):
            at = np.flatnonzero(chosen[r] & (guess[r] > -np.inf))
            s = self.x[at] @ q_all[r]
            best = np.lexsort((ids[at], -s))[:k]
            out.append((np.full(len(best), r), ids[at][best], s[best]))
        return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, pa.RecordBatch]]:
    """((list, salt), kind, rows) of each run of equal ones."""
    keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
    edges = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0), [True]]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield (int(keys[0, a]), int(keys[1, a])), int(keys[2, a]), batch.slice(a, b - a)


def _searched(sent, k: int, depth: int):
    """Of rows sorted by (list, salt, kind, id), kind 0 a block's vectors and kind 1 its queries, each query's best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, of, parts, block = sent.value, None, [], None
        for batch in batches:
            for key, kind, rows in _runs(batch) if batch.num_rows else ():
                if key != of:
                    of, parts, block = key, [], None
                if kind == 0:
                    parts.append(rows)
                    continue
                if not parts:
                    continue
                if block is None:
                    block = _Block(index, of[0], parts)
                asker, row = rows.column("id").to_numpy(), rows.column("row").to_numpy()
                q, _ = matrix(rows.column("vector"), index.dim)
                for i in range(0, len(asker), QUERIES):
                    nth, near, score = block.best(asker[i : i + QUERIES], q[i : i + QUERIES], k, depth)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (asker[i + nth], row[i + nth], near, score)], _FOUND)

    return run


def search(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, sample: int = SAMPLE, depth: int = DEPTH) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row where ``is_query`` holds."""
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("vec_id is not null and size(vector) > 0")
    rows = rows.where(F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0))
    schema = "query_id long, rank int, vec_id long, score double"
    sizes = rows.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, [_search(rows.where(F.size("vector") == r["dim"]), r["dim"], r["n"], k, sample, depth) for r in sorted(sizes, key=lambda r: r["dim"])])


def _search(rows: DataFrame, dim: int, total: int, k: int, sample: int, depth: int) -> DataFrame:
    """``search`` of valid vectors of ``dim`` components."""
    spark = rows.sparkSession
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 32)) < int(min(1.0, sample / total) * (1 << 32))).select("vec_id", "vector") if total > sample else rows.select("vec_id", "vector")
    x = np.array([r["vector"] for r in sorted(drawn.collect(), key=lambda r: r["vec_id"])], np.float64).reshape(-1, dim)
    index = Index(x, total, k)
    sent = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            v = matrix(batch.column(1), dim)[0].astype(np.float32)
            own = index.nearest(v)
            codes = index.codes(v, own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "vector", "asks", "list", "codes"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            v = matrix(batch.column(1), dim)[0].astype(np.float32)
            lists = index.order(v)[:, : index.probes].astype(np.int32)
            edge = pa.array(np.arange(len(v) + 1, dtype=np.int32) * lists.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(edge, pa.array(lists.ravel()))], ["query_id", "vector", "row", "lists"])

    stored = cut(rows.mapInArrow(assign, "vec_id long, vector array<double>, asks boolean, list int, codes binary"))
    salts = {r["list"]: -(-r["n"] // LIST_BLOCK) for r in stored.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    many = F.element_at(F.array(*(F.lit(int(salts.get(c, 1))) for c in range(len(index.centroids)))), F.col("list") + 1)
    base = stored.select("list", F.pmod(F.xxhash64("vec_id"), many).cast("int").alias("salt"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), F.lit(0).cast("long").alias("row"), "vector", "codes")
    asking = stored.where("asks").select(F.col("vec_id").alias("query_id"), F.xxhash64("vector").alias("row"), "vector").dropDuplicates(["query_id", "row"])
    asked = asking.select("query_id", "vector", "row").mapInArrow(visit, "query_id long, vector array<double>, row long, lists array<int>")
    asked = asked.select("query_id", "row", "vector", F.explode("lists").alias("list")).select("list", F.explode(F.sequence(F.lit(0), many - 1)).alias("salt"), F.lit(1).alias("kind"), F.col("query_id").alias("id"), "row", "vector", F.lit(None).cast("binary").alias("codes"))
    both = base.union(asked).repartition("list", "salt").sortWithinPartitions("list", "salt", "kind", "id")
    found = both.mapInArrow(_searched(sent, k, depth), "query_id long, row long, vec_id long, score double")
    place = F.row_number().over(W.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
