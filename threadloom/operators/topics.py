"""A tree of topics over all of a table's vectors, grown level by level, and counts by topic.

All nodes of a level are halved at once.  One pass over the table walks every vector down
the halves fixed so far and adds it to its nearer side; what leaves the tasks is a sum of
vectors for each node and side, and the driver holds only centroids, at most two for each of
a level's nodes.  A node's two sides start from the vector farthest from its centroid and
the one farthest from that (ties: the smaller id), so the same rows give the same tree
up to the order in which floating-point sums are added.

Vectors that are null, zero, hold nulls or non-finite components, or have another length than
the first centroid belong to no topic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: How deep the tree goes, what a side must hold, from what size and up to what coherence a node is halved, and how often its sides are moved.
DEPTH, LEAST, FEW, COHERENT, ROUNDS = 4, 50, 100, 0.85, 15


@dataclass(frozen=True)
class Node:
    """A topic: its members' count and mean, and the two directions its members are told apart by, if it has halves."""

    topic: str
    depth: int
    size: int
    mean: np.ndarray
    halves: np.ndarray | None = None

    @property
    def coherence(self) -> float:
        """Mean cosine of the members to their centroid: the length of the mean of unit vectors."""
        return float(np.linalg.norm(self.mean))

    @property
    def parent(self) -> str | None:
        return self.topic.rpartition(".")[0] or None


def _units(column: pa.Array, size: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(places of usable vectors, these at unit length)"""
    rows = [(i, v) for i, v in enumerate(column.to_pylist()) if v and (size is None or len(v) == size) and None not in v]
    x = np.array([v for _, v in rows], np.float64).reshape(len(rows), len(rows[0][1]) if rows else size or 0)
    length = np.sqrt(np.square(x).sum(1))
    fine = np.isfinite(length) & (length > 0)
    return np.array([i for i, _ in rows], np.int64)[fine], x[fine] / length[fine, None]


def _walked(x: np.ndarray, halves: dict[str, np.ndarray]) -> Iterator[np.ndarray]:
    """The topic of every vector, level by level, as far as there are halves."""
    at = np.full(len(x), "root", dtype=object)
    while True:
        yield at
        own = {t: at == t for t in set(at) if t in halves}
        if not own:
            return
        at = at.copy()
        for topic, rows in own.items():
            at[rows] = [f"{topic}.{k}" for k in (x[rows] @ halves[topic].T).argmax(1)]


def _last(x: np.ndarray, halves: dict[str, np.ndarray]) -> np.ndarray:
    *_, at = _walked(x, halves)
    return at


def _sums(rows: DataFrame, halves: dict[str, np.ndarray], size: int) -> dict[str, tuple[int, np.ndarray]]:
    """(members, mean) of each topic at the end of the walk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            _, x = _units(batch.column(1), size)
            at = _last(x, halves)
            for topic in set(at):
                own = x[at == topic]
                total[topic] = total.get(topic, 0) + np.append(own.sum(0), len(own))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["topic", "v"])

    parts = rows.mapInArrow(run, "topic string, v array<double>").select("topic", F.posexplode("v").alias("i", "x"))
    found: dict[str, np.ndarray] = {}
    for r in parts.groupBy("topic", "i").agg(F.sum("x").alias("x")).collect():
        found.setdefault(r["topic"], np.zeros(size + 1))[r["i"]] = r["x"]
    return {t: (int(v[-1]), v[:-1] / v[-1]) for t, v in found.items() if v[-1]}


def _farthest(rows: DataFrame, halves: dict[str, np.ndarray], size: int, targets: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of each topic in ``targets``, the unit vector of the member least like its target."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, x = _units(batch.column(1), size)
            at = _last(x, halves)
            out = [[], [], [], []]
            for topic in set(at) & set(targets):
                own = np.flatnonzero(at == topic)
                near = x[own] @ targets[topic]
                ids = batch.column(0).take(pa.array(places[own[near == near.min()]])).to_pylist()
                k = min(range(len(ids)), key=lambda j: (ids[j] is None, ids[j]))
                for column, value in zip(out, (topic, float(near.min()), ids[k], x[own[near == near.min()][k]].tolist()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], batch.schema.field(0).type), pa.array(out[3], pa.list_(pa.float64()))], ["topic", "near", "id", "v"])

    best = rows.mapInArrow(run, f"topic string, near double, id {kind}, v array<double>").groupBy("topic").agg(F.min_by("v", F.struct("near", "id")).alias("v"))
    return {r["topic"]: np.array(r["v"]) for r in best.collect()}


def fit(embeddings: DataFrame, id: str = "id", vector: str = "embedding", depth: int = DEPTH, least: int = LEAST, few: int = FEW, coherent: float = COHERENT, rounds: int = ROUNDS) -> list[Node]:
    """The tree of all of ``embeddings``; none for fewer than ``few`` vectors."""
    rows = embeddings.select(F.col(id).alias("id"), F.col(vector).alias("v"))
    first = rows.where(F.size("v") > 0).select(F.size("v").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    if first is None:
        return []
    size = first["n"]
    root = _sums(rows, {}, size).get("root")
    if root is None or root[0] < few:
        return []
    tree = {"root": Node("root", 0, *root)}
    fixed: dict[str, np.ndarray] = {}
    for level in range(depth):
        open_ = {t: n for t, n in tree.items() if n.depth == level and n.size >= few and n.coherence <= coherent}
        if not open_:
            break
        one = _farthest(rows, fixed, size, {t: n.mean for t, n in open_.items()})
        two = _farthest(rows, fixed, size, one)
        sides = {t: np.stack([one[t], two[t]]) for t in open_}
        for k in range(rounds):
            sums = _sums(rows, fixed | sides, size)
            moved = {t: np.stack([_direction(sums.get(f"{t}.{side}"), old[side]) for side in (0, 1)]) for t, old in sides.items()}
            if k == rounds - 1 or all(np.allclose(moved[t], sides[t], rtol=0, atol=1e-12) for t in sides):
                break
            sides = moved
        for topic, own in sides.items():
            both = [sums.get(f"{topic}.{k}", (0, None)) for k in (0, 1)]
            if min(n for n, _ in both) >= least:
                fixed[topic] = own
                tree |= {f"{topic}.{k}": Node(f"{topic}.{k}", level + 1, *both[k]) for k in (0, 1)}
    return [Node(n.topic, n.depth, n.size, n.mean, fixed.get(n.topic)) for n in tree.values()]


def _direction(found: tuple[int, np.ndarray] | None, before: np.ndarray) -> np.ndarray:
    length = 0.0 if found is None else np.linalg.norm(found[1])
    return found[1] / length if length > 0 else before


def assign(embeddings: DataFrame, tree: list[Node], id: str = "id", vector: str = "embedding") -> DataFrame:
    """(id, topic) of every row and each topic on its way from the root to its leaf; no rows without a tree."""
    kind = embeddings.schema[id].dataType.simpleString()
    halves = {n.topic: n.halves for n in tree if n.halves is not None}
    size = len(tree[0].mean) if tree else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, x = _units(batch.column(1), size)
            before = None
            for at in _walked(x, halves):
                new = np.ones(len(at), bool) if before is None else at != before
                before = at
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places[new])), pa.array(at[new].tolist(), pa.string())], ["id", "topic"])

    rows = embeddings.select(F.col(id).alias("id"), F.col(vector).alias("v"))
    return (rows if tree else rows.limit(0)).mapInArrow(run, f"id {kind}, topic string")


def leaves(topics: DataFrame, topic: str = "topic") -> DataFrame:
    """Topics that are nobody's parent."""
    parents = topics.select(F.regexp_extract(topic, r"^(.*)\.[01]$", 1).alias(topic)).where(F.col(topic) != "")
    return topics.select(topic).distinct().join(parents.distinct(), topic, "left_anti")


def facets(matches: DataFrame, members: DataFrame, leaf: DataFrame) -> DataFrame:
    """How many distinct threads of ``matches`` (id, thread_id) lie in each leaf topic of ``members`` (id, topic)."""
    own = members.join(F.broadcast(leaf), "topic", "left_semi")
    return matches.join(own, "id").groupBy("topic").agg(F.countDistinct("thread_id").alias("threads"))


def top_per(df: DataFrame, group: str, value: Column, most: int) -> DataFrame:
    """(group, value, n, nth): the ``most`` commonest values of each group, ties in order of value."""
    counted = df.select(group, value.alias("value")).groupBy(group, "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("nth", F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), "value"))).where(F.col("nth") <= most)


def shard_size(budget_mb: int, dimensions: int, copies: int = 3) -> int:
    """Vectors of four-byte components a shard may hold for a memory budget, if building holds so many copies; 1 at least."""
    return max(1, budget_mb * (1 << 20) // (dimensions * copies * 4))
