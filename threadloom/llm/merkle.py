"""A Merkle manifest of a table: binary hash trees per group and over the groups' roots, with a proof for every row.

Leaves are hashed in the scan, placed by a range sort, and folded bottom-up.  A persisted
level is a table of runs of ``2 ** STRIDE`` consecutive nodes (one row each), so it covers
``STRIDE`` binary levels and a table of n rows needs log(n) / STRIDE jobs.  Proofs go
top-down: each run inherits the proof of its parent node, and each of its nodes prepends its
own siblings.  What moves is one inherited proof for each run, never one for each row.

A proof is an array of steps from the leaf up: ``L`` or ``R`` (the side the sibling stands
on) and the sibling's digest, or ``-`` where a last node has no sibling and is hashed alone.

Null values hash as ``-``, so they differ from empty texts.  Groups are ordered bytewise, null
first; rows by key (null first), then by digest, so repeated rows get neighbouring leaves.
An empty table gives an empty result.  Columns beyond the hashed ones are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm.shared import cut

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STRIDE = 6


def digest(fields: list[Column]) -> Column:
    """SHA-256 (lowercase hex) of the fields, each its UTF-8 length, ``:`` and its value, or ``-`` for null."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def manifest(docs: DataFrame, tampered: dict[str, Column], changed: Column, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(key, leaf, subroot, root, proof, folded_root, verified) of every row.

    Where ``changed`` holds, the leaf that is folded up is made with the values of
    ``tampered`` in place of the row's own; a proof then fails unless these are equal.
    """
    own = [F.col(f) for f in fields]
    other = [tampered.get(f, F.col(f)) for f in fields]
    leaves = docs.select(
        F.col(key).alias("id"),
        F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("")).alias("tree"),
        digest(own).alias("hash"),
        F.when(changed, digest(other)).alias("other"),
    )
    levels, subroots = build(placed(cut(leaves), "id", "hash"), "id", "other")
    upper, roots = build(placed(subroots.select(F.col("tree").alias("name"), F.lit("").alias("tree"), "hash"), "name"), "name")
    root = roots.first()
    above = roots.select("tree", F.array().cast("array<string>").alias("proof"), "hash")
    start = proofs(upper, above, "name").select(F.col("name").alias("tree"), "proof", "hash")
    rows = proofs(levels, start, "id", "other").withColumnRenamed("hash", "leaf").withColumn("root", F.lit(root["hash"] if root else None).cast("string"))
    return folded(rows).select(F.col("id").alias(key), "leaf", F.col("root_of_tree").alias("subroot"), "root", "proof", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``pos`` (from 0, in ``order`` within ``tree``) and ``n``, the tree's size.

    Rows are range-sorted whatever the sizes of the trees; a position is the rows of the
    tree in earlier partitions plus the place in its own.
    """
    keys = [F.col("tree"), *(F.col(c).asc_nulls_first() for c in order)]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    ranged = cut(ranged.withColumn("part", F.shiftright("at", 33).cast("int")))
    parts = ranged.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = cut(parts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(W.partitionBy("tree")).alias("n")))
    return ranged.join(parts, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "shift", "part")


def build(nodes: DataFrame, *carried: str) -> tuple[list[DataFrame], DataFrame]:
    """(the persisted levels, (tree, hash) of the roots) of ``nodes`` (tree, pos, n, hash and what leaves carry)."""
    levels, done = [], []
    while True:
        run = F.struct("pos", "hash", *(carried if not levels else ()))
        grouped = nodes.groupBy("tree", F.shiftright("pos", STRIDE).alias("run"), "n").agg(F.array_sort(F.collect_list(run)).alias("nodes"))
        level = cut(grouped)
        levels.append(level)
        top = _levels(level).select("tree", F.col("run").alias("pos"), _count(STRIDE).alias("n"), F.get(f"l{STRIDE}", F.lit(0)).alias("hash"))
        done.append(top.where("n = 1").select("tree", "hash"))
        nodes = top.where("n > 1")
        if level.where(_count(STRIDE) > 1).isEmpty():
            break
    roots = done[0]
    for more in done[1:]:
        roots = roots.union(more)
    return levels, cut(roots)


def proofs(levels: list[DataFrame], roots: DataFrame, *carried: str) -> DataFrame:
    """Every leaf with its ``proof`` and ``root_of_tree``; ``roots`` has (tree, proof, hash) of the root's own proof to go on from."""
    last = roots.select("tree", F.lit(0).cast("long").alias("run"), F.col("proof").alias("above"), F.col("hash").alias("root_of_tree"))
    inherited = None
    for k in reversed(range(len(levels))):
        ends = last.join(levels[k].where(_count(STRIDE) == 1).select("tree"), "tree", "left_semi")
        inherited = ends if inherited is None else inherited.union(ends)
        runs = _levels(levels[k]).join(inherited, ["tree", "run"])
        node = F.explode("nodes").alias("node")
        each = runs.select("tree", "n", "above", "root_of_tree", *(f"l{j}" for j in range(STRIDE)), node)
        proof = F.concat(_siblings(F.col("node.pos")), "above")
        if k:
            inherited = each.select("tree", F.col("node.pos").alias("run"), proof.alias("above"), "root_of_tree")
    return each.select(*(F.col(f"node.{c}").alias(c) for c in ("hash", *carried)), proof.alias("proof"), "root_of_tree")


def folded(rows: DataFrame) -> DataFrame:
    """``rows`` with ``folded_root``: the leaf (``other`` where given) hashed up along the proof."""

    def up(h: Column, step: Column) -> Column:
        side, sibling = F.substring(step, 1, 1), F.substring(step, 2, 64)
        return F.sha2(F.when(side == "L", F.concat(sibling, h)).when(side == "R", F.concat(h, sibling)).otherwise(h), 256)

    return rows.withColumn("folded_root", F.aggregate("proof", F.coalesce("other", "leaf"), up))


def siblings_digest(proof: Column) -> Column:
    """SHA-256 of the siblings of a proof, from the leaf up."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.substring(s, 2, 64)), ""), 256)


def _count(k: int) -> Column:
    """Nodes of the tree ``k`` binary levels above a persisted one with ``n``."""
    return F.shiftright(F.col("n") + ((1 << k) - 1), k)


def _pair(below: Column):
    """Of a pair's number, its digest: a last node without a neighbour is hashed alone."""
    return lambda i: F.sha2(F.concat(F.get(below, i * 2), F.coalesce(F.get(below, i * 2 + 1), F.lit(""))), 256)


def _levels(runs: DataFrame) -> DataFrame:
    """``runs`` with the digests of each binary level in columns l0 to l<STRIDE>; a level of one node is passed on as it is."""
    out = runs.withColumn("l0", F.transform("nodes", lambda x: x["hash"]))
    for k in range(STRIDE):
        below = F.col(f"l{k}")
        pairs = F.sequence(F.lit(0), F.shiftright(F.size(below) - 1, 1))
        joined = F.transform(pairs, _pair(below))
        out = out.withColumn(f"l{k + 1}", F.when(_count(k) > 1, joined).otherwise(below))
    return out


def _siblings(pos: Column) -> Column:
    """The steps of a node's proof within its run."""
    steps = []
    for k in range(STRIDE):
        at = F.shiftright(pos.bitwiseAND((1 << STRIDE) - 1), k).cast("int")
        side = F.when(at.bitwiseAND(1) == 1, "L").otherwise("R")
        steps.append(F.when(_count(k) > 1, F.coalesce(F.concat(side, F.get(f"l{k}", at.bitwiseXOR(1))), F.lit("-"))))
    return F.array_compact(F.array(*steps))
