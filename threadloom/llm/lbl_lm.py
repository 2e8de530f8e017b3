"""Language-model scoring: a log-bilinear neural model beside an add-one unigram base.

Words are counted over all training documents.  A fixed number of the commonest words
(heads, by exact counts) are classes or carry their count to every task; all others
meet their counts in a join of (word, document, times) with the table of counts.

The model predicts the class of the next token: the commonest words, the end, and
64 classes of other words by their last two bytes.  Two position-wise context vectors
add up to a prediction, whose product with a class vector plus a bias is the class's
score.  It is trained by noise-contrastive estimation in numpy, each task going once
over its own training documents from the same start; the parameters are then averaged
by tokens; so the fit depends on how rows are dealt to tasks, and another split of
the same table gives slightly other scores, while the same split gives the same.  Log normalisers of all context pairs come from matrix products, so token
probabilities are normalised.  A word outside the classes has its class's probability
times its add-one share of that class.

Null text is an empty one (only the end is scored); documents with a null id learn
as id '' does; repeated rows are each scored and each learnt from; without training
documents every class is equally likely.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.shared import cut
from threadloom.llm.words import Words, mix, words

_U = np.uint64
#: Words whose counts go to every task (a table of at most this many rows), of which so many are classes.
HEADS = 1 << 15
CLASSES = 960
TAILS = 64
#: Vector length, noise samples a batch, tokens a batch, step size of the fit.
WIDTH, NOISE, BATCH, RATE = 24, 48, 4096, 0.1
_BLOCK = 1024
#: Counts from here on share a level of the histogram that finds the heads.
_TOP_LEVEL = 1 << 16
END = int(mix(np.array([0x454E44], np.uint64))[0]) & ~63 & ((1 << 63) - 1)


def keys_of(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all tokens with an end after each row, row edges); the low bits of a key are its tail class."""
    tail = (mix(w.tail.astype(np.uint64)) & _U(TAILS - 1)).astype(np.int64)
    key = (w.hash & _U(0x7FFFFFFFFFFFFFC0)).view(np.int64) | tail
    edge = w.row + np.arange(w.rows + 1)
    out = np.full(edge[-1], END, np.int64)
    inside = np.ones(edge[-1], bool)
    inside[edge[1:] - 1] = False
    out[inside] = key
    return out, edge


@dataclass
class Vocabulary:
    """Head words (ascending keys) with exact counts, their classes, and the sums behind the tail classes."""

    heads: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    tail_log: np.ndarray
    noise: np.ndarray
    tokens: int
    distinct: int

    def lookup(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class of each token, its place among the heads or -1)."""
        at = np.minimum(np.searchsorted(self.heads, key), len(self.heads) - 1)
        head = self.heads[at] == key
        cls = np.where(head, self.classes[at], CLASSES + (key & (TAILS - 1)))
        return cls, np.where(head, at, -1)


def vocabulary(head_counts: dict[int, int], tail: dict[int, list[int]]) -> Vocabulary:
    """``tail``: distinct words and tokens outside the heads by class."""
    heads = np.array(sorted({*head_counts, END}), np.int64)
    counts = np.array([head_counts.get(int(k), 0) for k in heads], np.int64)
    order = np.lexsort((heads, -counts, heads != END))
    classes = CLASSES + (heads & (TAILS - 1))
    classes[order[:CLASSES]] = np.arange(len(order[:CLASSES]))
    n = np.zeros(CLASSES + TAILS)
    np.add.at(n, classes, counts)
    distinct = np.array([tail.get(k, [0, 0])[0] for k in range(TAILS)], np.int64)
    tokens = np.array([tail.get(k, [0, 0])[1] for k in range(TAILS)], np.int64)
    n[CLASSES:] += tokens
    other = np.bincount(classes[order[CLASSES:]] - CLASSES, minlength=TAILS)
    share = n[CLASSES:] + distinct + other + 1
    noise = (n + 1) / (n + 1).sum()
    return Vocabulary(heads, counts, classes, np.log10(share), noise, int(counts.sum() + tokens.sum()), int((counts > 0).sum() + distinct.sum()))


class Model:
    """Context vectors for two positions, class vectors and biases, in one flat array."""

    def __init__(self, noise: np.ndarray, flat: np.ndarray | None = None):
        k = self.k = len(noise)
        self.noise = noise
        if flat is None:
            rng = np.random.RandomState(7)
            flat = np.concatenate([rng.normal(0, 0.1, (3 * k + 2) * WIDTH), np.log(noise)]).astype(np.float32)
        self.flat = flat.astype(np.float32)
        views = _Views(self.flat, k)
        self.first, self.second, self.out, self.bias = views.first, views.second, views.out, views.bias

    def log_normalisers(self) -> np.ndarray:
        """Natural log of the sum over classes for each pair of contexts (nearest first)."""
        table = np.empty((self.k + 1, self.k + 1), np.float32)
        for i in range(self.k + 1):
            s = (self.first[i] + self.second) @ self.out.T + self.bias
            top = s.max(1, keepdims=True)
            table[i] = np.log(np.exp(s - top).sum(1)) + top[:, 0]
        return table

    def train(self, one: np.ndarray, two: np.ndarray, cls: np.ndarray, squares: np.ndarray, rng: np.random.RandomState) -> None:
        """A step of noise-contrastive estimation over a batch; all its tokens share the noise samples."""
        noise = rng.choice(self.k, NOISE, p=self.noise)
        logn = np.log(NOISE * self.noise).astype(np.float32)
        q = self.first[one] + self.second[two]
        good = 1 / (1 + np.exp(np.clip((q * self.out[cls]).sum(1) + self.bias[cls] - logn[cls], -30, 30)))
        bad = -1 / (1 + np.exp(np.clip(-(q @ self.out[noise].T + self.bias[noise] - logn[noise]), -30, 30)))
        dq = good[:, None] * self.out[cls] + bad @ self.out[noise]
        step = np.zeros_like(self.flat)
        at = _Views(step, self.k)
        _add_rows(at.first, one, dq)
        _add_rows(at.second, two, dq)
        _add_rows(at.out, cls, good[:, None] * q)
        np.add.at(at.out, noise, bad.T @ q)
        at.bias += np.bincount(cls, good, self.k).astype(np.float32)
        np.add.at(at.bias, noise, bad.sum(0))
        squares += step * step
        self.flat += RATE * step / (np.sqrt(squares) + 1.0)


class _Views:
    def __init__(self, flat: np.ndarray, k: int):
        a, b, c = (k + 1) * WIDTH, 2 * (k + 1) * WIDTH, (3 * k + 2) * WIDTH
        self.first, self.second = flat[:a].reshape(k + 1, WIDTH), flat[a:b].reshape(k + 1, WIDTH)
        self.out, self.bias = flat[b:c].reshape(k, WIDTH), flat[c:]


def _add_rows(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    to[at[first]] += np.add.reduceat(rows[order], first, axis=0)


def contexts(cls: np.ndarray, edge: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the token before and of the one before that; ``start`` before a document's first."""
    one, two = np.full(len(cls), start), np.full(len(cls), start)
    one[1:], two[2:] = cls[:-1], cls[:-2]
    begins = edge[:-1]
    one[begins] = start
    two[begins] = start
    second = begins + 1
    two[second[second < edge[1:]]] = start
    return one, two


def counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words and ends of the training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return key, np.bincount(back, np.concatenate([n for _, n in held]), len(key)).astype(np.int64)

        for batch in batches:
            for w in words(batch.column(0)):
                held.append(np.unique(keys_of(w)[0], return_counts=True))
                size += len(held[-1][0])
                if size > 1 << 20:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 1 << 19:
                        yield pa.RecordBatch.from_arrays([*map(pa.array, held[0])], ["word", "n"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([*map(pa.array, merged())], ["word", "n"])

    return cut(docs.where("train").select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))


def commonest(docs: DataFrame) -> np.ndarray:
    """Keys (ascending) of the commonest words of all training documents, ties by key, and of the end."""
    return np.array(sorted({END, *_top(counts(docs))}), np.int64)


def _top(counted: DataFrame) -> dict[int, int]:
    """The ``HEADS`` commonest words with their counts, ties by key."""
    # histograms first: a plain limit would send HEADS rows of each task to the driver
    level, part = F.least(F.col("n"), F.lit(_TOP_LEVEL)), F.shiftright("word", 47)
    least, above = _reach(((-r["x"], r["count"]) for r in counted.groupBy(level.alias("x")).count().collect()), HEADS)
    top = counted.where(level >= -least)
    if -least < _TOP_LEVEL:
        last, _ = _reach(((r["x"], r["count"]) for r in counted.where(level == -least).groupBy(part.alias("x")).count().collect()), HEADS - above)
        top = top.where((level > -least) | (part <= last))
    return {r["word"]: r["n"] for r in top.orderBy(F.desc("n"), "word").limit(HEADS).collect()}


def _reach(counts: Iterable[tuple[int, int]], wanted: int) -> tuple[int, int]:
    """(the value at which the counts, in the order of values, add up to ``wanted``, or the last one, the sum before it)."""
    value, before, total = 0, 0, 0
    for value, n in sorted(counts):
        before, total = total, total + n
        if total >= wanted:
            break
    return value, before


def tail_words(docs: DataFrame, heads: np.ndarray) -> DataFrame:
    """(word, doc, times) of each document's words that aren't heads, and one row with times 0 for each document.

    A row with times 0 has the document's key for its word, so that such rows are spread.
    """
    known = docs.sparkSession.sparkContext.broadcast(heads)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = known.value
        for batch in batches:
            doc_all = batch.column(0).to_numpy(zero_copy_only=False)
            for w in words(batch.column(1)):
                key, edge = keys_of(w)
                row = np.repeat(np.arange(w.rows), np.diff(edge))
                at = np.minimum(np.searchsorted(heads, key), len(heads) - 1)
                tail = heads[at] != key
                k, r = key[tail], row[tail]
                order = np.lexsort((k, r))
                k, r = k[order], r[order]
                first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])])) if len(k) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(k)))
                doc = doc_all[w.first : w.first + w.rows]
                out = np.concatenate([k[first], doc]), np.concatenate([doc[r[first]], doc]), np.concatenate([times, np.zeros(w.rows, np.int64)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*map(pa.array, out)], ["word", "doc", "times"])

    return docs.select("key", "text").mapInArrow(spread, "word long, doc long, times int")


def tail_sums(docs: DataFrame, heads: np.ndarray, counted: DataFrame) -> DataFrame:
    """(key, x, y, rows) of each document key: log10(c+1) and known tokens over words that aren't heads, and the rows with the key.

    One row for each word of a document meets its count in a join and is added up again
    before it moves, so what moves grows with the table.
    """
    n = F.coalesce("n", F.lit(0))
    met = tail_words(docs, heads).join(counted, "word", "left").select(F.col("doc").alias("key"), "times", n.alias("n"))
    return met.groupBy("key").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("x"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("y"),
        F.count_if(F.col("times") == 0).alias("rows"),
    )


def fit(docs: DataFrame, v: Vocabulary) -> Model:
    """One pass of each task over its own training documents, parameters averaged by tokens; what is sent grows with the tasks."""
    context = docs.sparkSession.sparkContext
    known = context.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = known.value
        model, rng, seen = Model(v.noise), np.random.RandomState(11), 0
        squares = np.zeros_like(model.flat)
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            for w in words(batch.column(0)):
                key, edge = keys_of(w)
                cls, _ = v.lookup(key)
                held.append((*contexts(cls, edge, model.k), cls))
                size += len(cls)
                if size >= 16 * BATCH:
                    one, two, cls = (np.concatenate(x) for x in zip(*held, strict=True))
                    order = rng.permutation(size)
                    for i in range(0, size - BATCH + 1, BATCH):
                        at = order[i : i + BATCH]
                        model.train(one[at], two[at], cls[at], squares, rng)
                    rest = order[size - size % BATCH :]
                    held, seen = [(one[rest], two[rest], cls[rest])], seen + size - len(rest)
                    size = len(rest)
        if size:
            one, two, cls = (np.concatenate(x) for x in zip(*held, strict=True))
            for i in range(0, size, BATCH):
                model.train(one[i : i + BATCH], two[i : i + BATCH], cls[i : i + BATCH], squares, rng)
            seen += size
        if seen:
            pad = np.concatenate([model.flat.astype(np.float64) * seen, np.zeros(-len(model.flat) % _BLOCK)]).reshape(-1, _BLOCK).astype(np.float32)
            n = len(pad)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, float(seen))), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * _BLOCK), pa.array(pad.ravel()))], ["block", "weight", "sums"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            values = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, _BLOCK)
            for block, weight, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), values, strict=True):
                at = sums.setdefault(block, [0.0, np.zeros(_BLOCK)])
                at[0] += weight
                at[1] += x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(x / w).tolist() for w, x in sums.values()], pa.list_(pa.float32()))], ["block", "mean"])

    schema = "block int, weight double, sums array<float>"
    means = docs.where("train").select("text").mapInArrow(run, schema).repartition("block").mapInArrow(total, "block int, mean array<float>").collect()
    model = Model(v.noise)
    if means:
        flat = np.concatenate([np.array(r["mean"], np.float32) for r in sorted(means, key=lambda r: r["block"])])
        model = Model(v.noise, flat[: len(model.flat)])
    return model


def score(df: DataFrame, train: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, train, n_tokens, n_known, train_tokens, base_score, score) of each row of ``df``, learning from rows where ``train`` holds."""
    context = df.sparkSession.sparkContext
    docs = df.select(F.xxhash64(F.col(key), F.col(text)).alias("key"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text"), F.col(key).alias("id"))
    counted = counts(docs)
    top = _top(counted)
    by_tail = counted.groupBy(F.col("word").bitwiseAND(TAILS - 1).alias("tail")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect()
    tail = {r["tail"]: [r["words"], r["n"]] for r in by_tail}
    ends = {END: r["n"] for r in counted.where(F.col("word") == END).collect()}
    for word, n in (top | ends).items():
        tail[word & (TAILS - 1)][0] -= 1
        tail[word & (TAILS - 1)][1] -= n
    v = vocabulary(top | ends, tail)
    model = fit(docs, v)
    sent = context.broadcast((v, model.flat, model.log_normalisers()))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, flat, normaliser = sent.value
        model = Model(v.noise, flat)
        head_log = np.log10(v.counts + 1.0)
        for batch in batches:
            for w in words(batch.column(2)):
                key, edge = keys_of(w)
                cls, head = v.lookup(key)
                one, two = contexts(cls, edge, model.k)
                value = np.empty(len(cls))
                for i in range(0, len(cls), 1 << 16):
                    a, b, c = one[i : i + (1 << 16)], two[i : i + (1 << 16)], cls[i : i + (1 << 16)]
                    value[i : i + (1 << 16)] = np.einsum("ij,ij->i", model.first[a] + model.second[b], model.out[c]) + model.bias[c] - normaliser[a, b]
                value /= np.log(10.0)
                is_head = head >= 0
                counted = np.where(is_head, head_log[head], 0.0)
                inside = cls >= CLASSES
                value += np.where(inside, counted - v.tail_log[np.maximum(cls - CLASSES, 0)], 0.0)
                sure = is_head & (v.counts[head] > 0)
                out = [np.add.reduceat(x, edge[:-1]) for x in (value, counted, sure.astype(np.int64))]
                part = batch.slice(w.first, w.rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(np.diff(edge)), *map(pa.array, out)], ["key", "train", "id", "n_tokens", "model", "counted", "known"])

    scored = docs.mapInArrow(run, f"key long, train boolean, id {kind}, n_tokens long, model double, counted double, known long")
    sums = tail_sums(docs, v.heads, counted)
    tail_log, tail_known = F.coalesce(F.col("x") / F.col("rows"), F.lit(0.0)), F.coalesce((F.col("y") / F.col("rows")).cast("long"), F.lit(0).cast("long"))
    return scored.join(sums, "key", "left").select(
        F.col("id").alias(key),
        "train",
        "n_tokens",
        (F.col("known") + tail_known).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("counted") + tail_log - F.col("n_tokens") * float(np.log10(v.tokens + v.distinct + 1))).alias("base_score"),
        (F.col("model") + tail_log).alias("score"),
    )
