"""Near-duplicate vectors by sorted projection passes.

In each pass every vector gets 62 random sign bits, vectors are put in the order of
(label, bits), and each is compared with the ones before it in a bounded window.
Pairs of cosine at least the threshold, in double precision, are united; of a
window only a spanning set of its links is passed on.  Passes differ in their
projections, so a pair that one order keeps apart meets in another.  Links counts
don't come from the windows: members of a component are compared with all others
of it, block against block, so groups far larger than a window count in full.

Exactly equal vectors of a label are one node that knows how many it stands for.
Null or zero vectors, ones with null or non-finite components, null labels and null
ids link with nothing; such rows are their own component (null for a null id).
Vectors of different lengths link with nothing either.  Repeated ids keep a row
each.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.graph import components
from threadloom.llm.shared import cut

PASSES = 8
WINDOW = 512
BITS = 62
#: Vectors of a component's block, and rows of a block compared at once.
BLOCK = 4096
ROWS = 256


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(double matrix, which rows are valid vectors of ``dim`` components)."""
    n = len(column)
    out = np.zeros((n, dim))
    length = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    full = length == dim
    flat = column.filter(pa.array(full)).flatten()
    out[full] = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
    ok = full & np.isfinite(out).all(1)
    out[~ok] = 0
    ok &= (out != 0).any(1)
    return out, ok


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _nodes(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, node, label, vector) of each row; node is null for rows that take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node: list[int | None] = []
            ids, labels, vectors = batch.columns
            lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ok = np.zeros(batch.num_rows, bool)
            data: list[bytes | None] = [None] * batch.num_rows
            for dim in np.unique(lengths[lengths > 0]):
                x, fine = matrix(vectors, int(dim))
                ok |= fine
                x += 0.0  # one sign of zero
                for k in np.flatnonzero(fine):
                    data[k] = x[k].tobytes()
            for k, (i, mark) in enumerate(zip(ids.to_pylist(), labels.to_pylist(), strict=True)):
                fine = ok[k] and i is not None and mark is not None
                node.append(int.from_bytes(hashlib.blake2b(data[k] + mark.encode(), digest_size=8).digest(), "little", signed=True) if fine else None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(node, pa.int64()), labels, vectors], ["key", "node", "label", "vector"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, f"key {kind}, node long, label string, vector array<double>")


def _order_bits(nth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            bits = np.zeros(batch.num_rows, np.int64)
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                x, _ = matrix(vectors.take(pa.array(at)), int(dim))
                planes = np.random.RandomState(1000 * nth + 17).normal(size=(int(dim), BITS))
                bits[at] = ((x @ planes > 0).astype(np.int64) << np.arange(BITS - 1, -1, -1)).sum(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits)], ["node", "label", "vector", "bits"])

    return run


def _windows(threshold: float, window: int):
    """Of sorted rows, a spanning set of the links between rows at most ``window`` apart or more (a whole tile is compared)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, nodes, unit, roots = None, np.zeros(0, np.int64), None, np.zeros(0, np.int64)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            labels = batch.column(1).to_pylist()
            lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            marks = list(zip(labels, lengths.tolist(), strict=True))
            i = 0
            edges: list[tuple[int, int]] = []
            while i < len(ids):
                j = i + 1
                while j < len(ids) and marks[j] == marks[i] and j - i < window:
                    j += 1
                x = _unit(matrix(batch.column(2).slice(i, j - i), int(lengths[i]))[0])
                if marks[i] != label or unit is None:
                    label, nodes, unit, roots = marks[i], np.zeros(0, np.int64), x[:0], np.zeros(0, np.int64)
                before = len(nodes)
                nodes, unit, roots = np.concatenate([nodes, ids[i:j]]), np.concatenate([unit, x]), np.concatenate([roots, ids[i:j]])
                near = np.tril(x @ unit.T >= threshold, before - 1)
                for k in np.flatnonzero(near.any(1)):
                    own = roots[before + k]
                    for r in np.unique(roots[: before + k][near[k, : before + k]]):
                        if r != own:
                            edges.append((int(nodes[before + k]), int(r)))
                            roots[roots == own] = r
                            own = r
                nodes, unit, roots = nodes[-window:], unit[-window:], roots[-window:]
                i = j
            if edges:
                a, b = np.array(edges, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _count_block(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table.column("side").to_numpy()
        length = pc.list_value_length(table.column("vector")).to_numpy()
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        vectors = table.column("vector").combine_chunks()
        out_node, out_n = [], []
        for dim in np.unique(length):
            left, right = (np.flatnonzero((side == s) & (length == dim)) for s in (0, 1))
            if len(left) and len(right):
                x, y = (_unit(matrix(vectors.take(pa.array(k)), int(dim))[0]) for k in (left, right))
                out_node.append(node[left])
                out_n.append(np.concatenate([(x[a : a + ROWS] @ y.T >= threshold) @ copies[right] for a in range(0, len(x), ROWS)]))
        if not out_node:
            return pa.table({"node": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        return pa.table({"node": np.concatenate(out_node), "n": np.concatenate(out_n).astype(np.int64)})

    return run


def link(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98, passes: int = PASSES, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(key, n_links, component_id, kept) of each row of ``df``; a component's vectors are compared in blocks of ``block``."""
    rows = cut(_nodes(df, key, vector, label))
    reps = cut(rows.where("node is not null").groupBy("node").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector")))
    vectors = reps.select("node", "label", "vector")
    found = []
    for nth in range(passes):
        ordered = vectors.mapInArrow(_order_bits(nth), "node long, label string, vector array<double>, bits long").repartitionByRange("label", "bits").sortWithinPartitions("label", F.size("vector"), "bits", "node")
        found.append(cut(ordered.mapInArrow(_windows(threshold, window), "a long, b long")))
    comps = cut(components(reduce(DataFrame.union, found)))
    size = comps.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    members = reps.join(comps, "node").join(size, "root").withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = cut(members.select("root", "node", "copies", "vector", "blocks", "own"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sides = members.select("root", "node", "copies", "vector", F.col("own").alias("i"), other.alias("j"), F.lit(0).alias("side")).union(members.select("root", "node", "copies", "vector", other.alias("i"), F.col("own").alias("j"), F.lit(1).alias("side")))
    counted = sides.groupBy("root", "i", "j").applyInArrow(_count_block(threshold), "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    placed = reps.select("node", "least", "copies").join(comps, "node", "left").withColumn("root", F.coalesce("root", "node"))
    label_of = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    known = placed.join(label_of, "root").join(counted, "node", "left").select("node", "component_id", (F.coalesce("n", "copies") - 1).alias("n_links"))
    out = rows.select("key", "node").join(known, "node", "left")
    component = F.coalesce("component_id", "key")
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))
