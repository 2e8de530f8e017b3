"""Exact Jaccard self-join of shingle sets by universe partition and the pigeonhole principle.

With |A & B| / |A u B| >= t, the sets differ in at most H = (1-t)/(1+t) (|A|+|B|)
shingles.  For a band of set sizes (one doubling) the universe of shingle hashes
is cut into m segments.  Those H shingles touch at most H segments, so of any
H + 1 segments one at least is equal in both sets.  Every set is indexed under the
segment subsets of its own band; as the larger of a pair it probes its band and,
where sizes reach that far, the one below.  Allocation by cost: any H + 1 segments
do, so a probe takes those that fewest sets can share.  A sketch of fixed size over
the shingles of all documents tells frequent shingles (boilerplate), a segment costs
what its rarest shingle does, and among equals the longest come first; empty ones
are left out.  A set with too few segments that aren't empty spends more on some:
one-deletion neighbourhoods of a segment's subset find it after one change, so
such a segment counts twice.  Only bands in which such a set exists index
neighbourhoods.  Candidates are verified exactly.

Sets are collapsed to distinct ones first.  Pairs in a group of equal signatures
are all tested in small groups; in larger ones members are tested against a
hub.  Large groups whose members still lie in different components are joined to
clusters of any size, and a cluster's sets are compared block against block, but for
blocks whose sets are all of one component or too different in size, in tasks that
pass on only spanning links.  So no link between different texts is lost, and no
group emits all its pairs.

Null or empty text: no shingles, no links.  Fewer words than a shingle has: the
whole sequence is the one shingle.  Rows with a null key get their count and a null
component.  Equal rows are equal sets.  Empty table: empty result.  Shingles are known by
64-bit hashes of their words and sets by 64-bit hashes of their shingles: exact up to collisions of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.graph import components
from threadloom.llm.shared import cut, small_batches
from threadloom.llm.words import mix, shingle_sets, words

_U = np.uint64
#: Mean number of shingles in a segment of a band's largest sets.
LOAD = 3.5
#: Groups up to this size test all pairs; larger ones hubs first.
SMALL_GROUP = 6
#: Hubs are chosen in so many ways, by signature.
CHANNELS = 4
_INDEX, _PROBE = 1, 2
_FILTER_BITS = 23
#: Sets in a block of a cluster.
BLOCK = 512
#: Rows of one signature held at once; a longer group is handed on in parts.
LONGEST_RUN = 1 << 20
#: Slots of the sketch of shingles, and how many times a task's mean count makes a slot frequent.
SLOTS, FREQUENT = 1 << 16, 4


def band_of(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(n, 1) + 0.5)).astype(np.int64)


def segments_of(band: np.ndarray) -> np.ndarray:
    return np.maximum(1, np.ceil((2.0 ** (band + 1)) / LOAD)).astype(np.int64)


class Threshold:
    """100 * intersection >= percent * union, in whole numbers."""

    def __init__(self, percent: int):
        self.percent = percent

    def errors(self, a, b):
        """The most shingles two such sets of sizes a and b differ in."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def least(self, n):
        """The least size that goes with n."""
        return -(-n * self.percent // 100)


def digests(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit digest for each set, equal for equal sets."""
    with np.errstate(over="ignore"):
        total = np.concatenate([[_U(0)], np.cumsum(mix(h ^ _U(0x5851F42D4C957F2D)))])
        n = np.diff(at)
        return mix(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64) * _U(0x14057B7EF767814F)).view(np.int64)


def _segmented(h: np.ndarray, at: np.ndarray, band: np.ndarray, cost: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Segments that aren't empty: (row, segment, count, sum of mixed hashes, start in order), the mixed hashes in
    order, and what each segment costs: the count of its rarest shingle, by slots."""
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    m = segments_of(band)
    seg = ((h >> _U(32)) * m[row].astype(np.uint64) >> _U(32)).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(m)])[:-1]
    key = base[row] + seg
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        mixed = mix(h + _U(0x632BE59BD9B4E019))[order]
        total = np.add.reduceat(mixed, first) if len(first) else np.zeros(0, np.uint64)
    count = np.diff(np.append(first, len(key)))
    r = row[order][first] if len(first) else np.zeros(0, np.int64)
    price = np.minimum.reduceat(cost[_slots(h[order])], first) if cost is not None and len(first) else np.zeros(len(first), np.int64)
    return r, key[first] - base[r], count, total, first, mixed, price


def _slots(h: np.ndarray) -> np.ndarray:
    return (h & _U(SLOTS - 1)).astype(np.int64)


def _signature(band: np.ndarray, seg: np.ndarray, total: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(total * _U(0x9FB21C651E98DF25) + mix(band.astype(np.uint64) << _U(40) | seg.astype(np.uint64))).view(np.int64)


def _needs(n: np.ndarray, band: np.ndarray, probed: np.ndarray, t: Threshold) -> np.ndarray:
    """Segments a set of size n must hold equal in the band it probes, or 0 where sizes don't reach it."""
    top = np.minimum(2 ** (probed + 1) - 1, n)
    reach = (probed >= 0) & (top >= t.least(n)) & (n > 0)
    return np.where(reach, t.errors(n, top) + 1, 0)


def hard_bands(h: np.ndarray, at: np.ndarray, t: Threshold) -> tuple[int, int]:
    """Bits of the bands in which some set needs neighbourhoods, and in which some needs even empty segments."""
    n = np.diff(at)
    hard = very = 0
    for step in (0, 1):
        own = band_of(n)
        probed = own - step
        need = _needs(n, own, probed, t)
        rows = np.flatnonzero(need > 0)
        if len(rows):
            r, *_ = _segmented(*_take(h, at, rows), probed[rows])
            full = np.bincount(r, minlength=len(rows))
            hard |= int(np.bitwise_or.reduce(1 << probed[rows][full < need[rows]])) if (full < need[rows]).any() else 0
            very |= int(np.bitwise_or.reduce(1 << probed[rows][2 * full < need[rows]])) if (2 * full < need[rows]).any() else 0
    return hard, very


def _take(h: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(at)[rows]
    edge = np.concatenate([[0], np.cumsum(n)])
    return h[np.repeat(at[:-1][rows] - edge[:-1], n) + np.arange(edge[-1])], edge


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def signatures(h: np.ndarray, at: np.ndarray, t: Threshold, hard: int, very: int, cost: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, row, role) of the sets; a set's own band carries both roles.  ``cost``: counts of frequent slots of shingles."""
    n = np.diff(at)
    own = band_of(n)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for step in (0, 1):
        probed = own - step
        need_all = _needs(n, own, probed, t)
        rows = np.flatnonzero((need_all > 0) if step else (n > 0))
        if not len(rows):
            continue
        need, band = need_all[rows], probed[rows]
        r, seg, count, total, first, mixed, price = _segmented(*_take(h, at, rows), band, cost)
        sig = _signature(band[r], seg, total)
        full = np.bincount(r, minlength=len(rows))
        start = np.cumsum(full) - full
        rank = np.empty(len(r), np.int64)
        cheapest = np.lexsort((-count, price, r))
        rank[cheapest] = np.arange(len(r)) - start[r[cheapest]]
        probe = rank < need[r]
        role = np.where(probe, _PROBE, 0) | (0 if step else _INDEX)
        keep = role > 0
        out.append((sig[keep], rows[r[keep]], role[keep]))
        # one-deletion neighbourhoods
        open_band = (hard >> band) & 1 == 1
        indexed = open_band[r] if not step else np.zeros(len(r), bool)
        lack = need - full
        spend = (lack[r] > 0) & (full[r] - 1 - rank < lack[r])  # of equal price the shortest ones
        both = indexed | spend
        if both.any():
            which = np.flatnonzero(both)
            items = _ranges(first[which], count[which])
            of = np.repeat(which, count[which])
            with np.errstate(over="ignore"):
                less = _signature(band[r[of]], seg[of], total[of] - mixed[items])
            out.append((less, rows[r[of]], np.where(indexed[of], _INDEX, 0) | np.where(spend[of], _PROBE, 0)))
        wide = (very >> band) & 1 == 1
        if wide.any():
            m = segments_of(band)
            at_all = np.flatnonzero(wide)
            r_all = np.repeat(at_all, m[at_all])
            seg_all = _ranges(np.zeros(len(at_all), np.int64), m[at_all])
            taken = set(zip(r.tolist(), seg.tolist(), strict=True))
            empty = np.array([(a, b) not in taken for a, b in zip(r_all.tolist(), seg_all.tolist(), strict=True)], bool)
            r_all, seg_all = r_all[empty], seg_all[empty]
            role = (0 if step else _INDEX) | np.where(2 * full[r_all] < need[r_all], _PROBE, 0)
            ok = role > 0
            out.append((_signature(band[r_all], seg_all, np.zeros(len(r_all), np.uint64))[ok], rows[r_all][ok], role[ok]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _pairs(node: np.ndarray, size: np.ndarray, role: np.ndarray, left: np.ndarray, right: np.ndarray, t: Threshold) -> np.ndarray:
    """Which of the pairs (left, right) of places have fitting roles and sizes and different nodes."""
    roles = ((role[left] & _INDEX > 0) & (role[right] & _PROBE > 0)) | ((role[left] & _PROBE > 0) & (role[right] & _INDEX > 0))
    a, b = np.minimum(size[left], size[right]), np.maximum(size[left], size[right])
    return roles & (a >= t.least(b)) & (node[left] != node[right])


def _groups(batches: Iterator[pa.RecordBatch], columns: int, most: int) -> Iterator[tuple[tuple[np.ndarray, ...], bool]]:
    """Runs of whole groups of the sorted first column, each with False; a group longer than ``most`` comes in parts, each with True."""
    held, parted = None, None
    for batch in batches:
        now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(columns)]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        last = int(np.searchsorted(now[0], now[0][-1], "left"))
        rest = int(np.searchsorted(now[0][:last], parted, "right")) if parted is not None else 0
        if rest:
            yield tuple(x[:rest] for x in now), True
        if last > rest:
            yield tuple(x[rest:last] for x in now), False
        held = [x[last:] for x in now]
        if len(held[0]) > most:
            parted = held[0][0]
            yield tuple(held), True
            held = [x[:0] for x in held]
    if held is not None and len(held[0]):
        yield tuple(held), parted is not None and held[0][0] == parted


def _merge_same(sig, node, size, role):
    """One row for each signature and node, roles joined."""
    order = np.lexsort((node, sig))
    sig, node, size, role = sig[order], node[order], size[order], role[order]
    first = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]))
    return sig[first], node[first], size[first], np.bitwise_or.reduceat(role, first)


def _all_pairs(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs in small runs."""
    left, right = [], []
    for c in np.unique(count[count > 1]):
        s = start[count == c]
        i, j = np.triu_indices(int(c), 1)
        left.append((s[:, None] + i[None, :]).ravel())
        right.append((s[:, None] + j[None, :]).ravel())
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _first_pairs(t: Threshold, most: int):
    """Pairs (a, b) of small groups and of members and hubs, and the members (a, sig) of groups that aren't settled so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (sig, node, size, role), part in _groups(batches, 4, most):
            sig, node, size, role = _merge_same(sig, node, size, role)
            start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            count = np.diff(np.append(start, len(sig)))
            probed = (np.bitwise_or.reduceat(role, start) & _PROBE > 0) | part
            small = (count <= SMALL_GROUP) & probed & (not part)
            left, right = _all_pairs(start[small], count[small])
            big = np.flatnonzero(probed & ~small)
            places = _ranges(start[big], count[big])
            of = np.repeat(np.arange(len(big)), count[big])
            if len(big):
                with np.errstate(over="ignore"):
                    way = mix((sig[places] & (CHANNELS - 1)).astype(np.uint64) + _U(7))
                    luck = mix(node[places].view(np.uint64) ^ way) >> _U(1)
                luck = luck.astype(np.int64) | np.where(role[places] == (_INDEX | _PROBE), 0, 1 << 62)
                order = np.lexsort((luck, of))
                hub = places[order[np.flatnonzero(np.concatenate([[True], of[order][1:] != of[order][:-1]]))]]
                left, right = np.concatenate([left, hub[of]]), np.concatenate([right, places])
            ok = _pairs(node, size, role, left, right, t)
            a, b = np.minimum(node[left], node[right])[ok], np.maximum(node[left], node[right])[ok]
            if len(a):
                ab = np.unique(np.stack([a, b]), axis=1) if len(a) < 1000 else _unique_pairs(a, b)
                k = ab.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(ab[0]), pa.array(ab[1]), pa.nulls(k, pa.int64())], ["a", "b", "sig"])
            if len(places):
                k = len(places)
                yield pa.RecordBatch.from_arrays([pa.array(node[places]), pa.nulls(k, pa.int64()), pa.array(sig[places])], ["a", "b", "sig"])

    return run


def _unique_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return np.stack([a[keep], b[keep]])


def _compared(t: Threshold):
    """Of two blocks of sets, links between components, no more than hold them together."""

    def run(table: pa.Table) -> pa.Table:
        side, node, comp = (table.column(c).to_numpy() for c in ("side", "node", "comp"))
        lists = table.column("shingles").combine_chunks()
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(size)), size)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        place = np.empty(len(side), np.int64)
        place[left], place[right] = np.arange(len(left)), np.arange(len(right))
        of_left = side[row] == 0
        shared = np.intersect1d(flat[of_left], flat[~of_left])
        at = np.minimum(np.searchsorted(shared, flat), max(len(shared) - 1, 0))
        has = shared[at] == flat if len(shared) else np.zeros(len(flat), bool)
        both = np.zeros((len(left), len(right)), np.float32)
        for c in range(0, len(shared), 4096):
            now = has & (at >= c) & (at < c + 4096)
            x, y = np.zeros((len(left), 4096), np.float32), np.zeros((len(right), 4096), np.float32)
            for z, mine in ((x, now & of_left), (y, now & ~of_left)):
                z[place[row[mine]], at[mine] - c] = 1
            both += x @ y.T
        both = both.astype(np.int64)
        linked = (100 * both >= t.percent * (size[left][:, None] + size[right][None, :] - both)) & (comp[left][:, None] != comp[right][None, :])
        root = {int(c): int(c) for c in np.unique(comp)}
        edges: list[tuple[int, int]] = []
        for i in np.flatnonzero(linked.any(1)):
            for j in np.flatnonzero(linked[i]):
                ends = []
                for c in (int(comp[left[i]]), int(comp[right[j]])):
                    while root[c] != c:
                        root[c] = c = root[root[c]]
                    ends.append(c)
                if ends[0] != ends[1]:
                    root[max(ends)] = min(ends)
                    edges.append((int(node[left[i]]), int(node[right[j]])))
        a, b = np.array(edges, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return run


def _sets(docs: DataFrame, size: int, wanted: np.ndarray) -> DataFrame:
    """(node, set) of the distinct sets whose node the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for w in words(batch.column(0)):
                h, at = shingle_sets(w, size)
                node = digests(h, at)
                pick = np.flatnonzero((np.diff(at) > 0) & _filtered(node, wanted))
                pick = np.array([k for k in pick if node[k] not in seen and not seen.add(int(node[k]))], np.int64)
                if len(pick):
                    if len(seen) > 2_000_000:
                        seen.clear()
                    own, edge = _take(h, at, pick)
                    yield pa.RecordBatch.from_arrays([pa.array(node[pick]), pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(own.view(np.int64)))], ["node", "shingles"])

    return docs.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def _filter_slots(node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = mix(node.view(np.uint64))
    return (x >> _U(64 - _FILTER_BITS)).astype(np.int64), (x & _U((1 << _FILTER_BITS) - 1)).astype(np.int64)


def _filtered(node: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    out = np.ones(len(node), bool)
    for slot in _filter_slots(node):
        out &= (wanted[slot >> 6] >> (slot & 63).astype(np.uint64)) & _U(1) == 1
    return out


def _wanted(pairs: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size (one megabyte) over the nodes of the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (_FILTER_BITS - 6), np.uint64)
        for batch in batches:
            for k in (0, 1):
                for slot in _filter_slots(batch.column(k).to_numpy(zero_copy_only=False)):
                    np.bitwise_or.at(bits, slot >> 6, _U(1) << (slot & 63).astype(np.uint64))
        has = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(bits[has].view(np.int64))], ["word", "bits"])

    got = pairs.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect()
    out = np.zeros(1 << (_FILTER_BITS - 6), np.uint64)
    for r in got:
        out[r["word"]] = _U(r["bits"] & 0xFFFFFFFFFFFFFFFF)
    return out


def _verified(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs that link, by their whole sets."""
    sets = _sets(docs, size, _wanted(pairs))
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def _by_blocks(docs: DataFrame, clusters: DataFrame, size: int, t: Threshold, block: int) -> DataFrame:
    """Links between components of each cluster (root, node, comp), its blocks of sets compared two by two.

    Components of a block's size and more have blocks of their own, blocks hold sets of
    like sizes, and only blocks that could hold a link between components meet.
    """
    wanted = _wanted(clusters.select(F.col("node").alias("a"), F.col("node").alias("b")))
    whole = clusters.groupBy("root", "comp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= block).select("root", "comp", F.lit(True).alias("whole"))
    own = clusters.join(whole, ["root", "comp"], "left").withColumn("whole", F.coalesce("whole", F.lit(False))).withColumn("of", F.when(F.col("whole"), F.col("comp")).otherwise(F.lit(0)))
    own = own.join(_sets(docs, size, wanted), "node").withColumn("scale", F.floor(F.log2(F.size("shingles")) * 4).cast("int"))
    own = cut(own)
    key = ["root", "whole", "of", "scale"]
    salts = own.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("salts"))
    name = F.xxhash64(*key, "salt")
    dealt = own.join(salts, key).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).select("node", "comp", "shingles", name.alias("block"))
    blocks = cut(salts.withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).select("root", "whole", "of", "scale", name.alias("block")))
    # sizes of linked sets lie within a factor of 100 / percent
    reach = int(np.ceil(4 * np.log2(100 / t.percent)))
    one, two = blocks.alias("one"), blocks.alias("two")
    same = F.col("one.whole") & F.col("two.whole") & (F.col("one.of") == F.col("two.of"))
    met = one.join(two, (F.col("one.root") == F.col("two.root")) & (F.col("one.block") <= F.col("two.block")) & (F.abs(F.col("one.scale") - F.col("two.scale")) <= reach) & ~same)
    met = cut(met.select(F.col("one.block").alias("i"), F.col("two.block").alias("j")))
    sides = [dealt.join(met, F.col("block") == F.col(end)).select("node", "comp", "shingles", "i", "j", F.lit(side).alias("side")) for side, end in enumerate("ij")]
    return sides[0].union(sides[1]).groupBy("i", "j").applyInArrow(_compared(t), "a long, b long")


def _frequent(profile: DataFrame) -> np.ndarray:
    """Counts of the slots of shingles that some task found frequent; 0 elsewhere."""
    out = np.zeros(SLOTS, np.int64)
    counted = profile.where("n is null").select(F.explode(F.arrays_zip("slots", "counts")).alias("z")).groupBy("z.slots").agg(F.sum("z.counts").alias("n"))
    for slot, n in counted.collect():
        out[slot] = n
    return out


def link(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, longest_run: int = LONGEST_RUN, block: int = BLOCK) -> DataFrame:
    """(key, n_shingles, component_id) of each row of ``df``: the least key reachable by links, its own included."""
    t = Threshold(percent)
    docs = df.select(F.col(text).alias("text"))

    small_batches(df.sparkSession)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, seen = ["key", "n", "node", "hard", "very", "slots", "counts"], np.zeros(SLOTS, np.int64)
        batch = None
        for batch in batches:
            for w in words(batch.column(1)):
                h, at = shingle_sets(w, size)
                hard, very = hard_bands(h, at, t)
                k = w.rows
                seen += np.bincount(_slots(h), minlength=SLOTS)
                none = pa.nulls(k, pa.list_(pa.int32())), pa.nulls(k, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, k), pa.array(np.diff(at)), pa.array(digests(h, at)), pa.array(np.full(k, hard)), pa.array(np.full(k, very)), *none], names)
        often = np.flatnonzero(seen > FREQUENT * (seen.mean() + 2))
        if len(often):
            blank = pa.nulls(1, batch.schema.field(0).type), *[pa.nulls(1, pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*blank, pa.array([often.astype(np.int32)], pa.list_(pa.int32())), pa.array([seen[often]], pa.list_(pa.int64()))], names)

    kind = df.schema[key].dataType.simpleString()
    profiled = cut(df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(profile, f"key {kind}, n long, node long, hard long, very long, slots array<int>, counts array<long>"))
    rows = profiled.where("n is not null").select("key", "n", "node")
    cost = _frequent(profiled)
    bands = profiled.agg(F.bit_or("hard").alias("hard"), F.bit_or("very").alias("very")).first()
    hard, very = bands["hard"] or 0, bands["very"] or 0

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for w in words(batch.column(0)):
                h, at = shingle_sets(w, size)
                node = digests(h, at)
                pick = np.array([k for k in np.flatnonzero(np.diff(at) > 0) if node[k] not in seen and not seen.add(int(node[k]))], np.int64)
                if len(seen) > 2_000_000:
                    seen.clear()
                if len(pick):
                    h, at = _take(h, at, pick)
                    sig, row, role = signatures(h, at, t, hard, very, cost)
                    yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(node[pick][row]), pa.array(np.diff(at)[row].astype(np.int32)), pa.array(role.astype(np.int32))], ["sig", "node", "size", "role"])

    signed = docs.mapInArrow(sign, "sig long, node long, size int, role int")
    found = cut(signed.repartition("sig").sortWithinPartitions("sig").mapInArrow(_first_pairs(t, longest_run), "a long, b long, sig long"))
    links = cut(_verified(docs, cut(found.where("b is not null").select("a", "b").distinct()), size, percent))
    comps = cut(components(links))
    placed = found.where("b is null").select("sig", F.col("a").alias("node")).join(comps, "node", "left").select("sig", "node", F.coalesce("root", "node").alias("comp"))
    mixed = placed.groupBy("sig").agg(F.min("node").alias("least"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("sig", "least")
    groups = cut(placed.join(mixed, "sig").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct())
    if not groups.isEmpty():
        clusters = components(groups).join(comps.select("node", F.col("root").alias("comp")), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        more = cut(_by_blocks(docs, cut(clusters), size, t, block))
        # components known so far are edges already
        comps = cut(components(comps.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)))
    classes = rows.where("n > 0").groupBy("node").agg(F.min("key").alias("least"))
    placed = classes.join(comps, "node", "left").withColumn("root", F.coalesce("root", "node"))
    label = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    label = placed.join(label, "root").select("node", "component_id")
    return (
        rows.join(label, "node", "left")
        .select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("key").isNotNull(), F.col("component_id"))).otherwise(F.col("key")).alias("component_id"))
    )
