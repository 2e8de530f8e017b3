"""An inverted index with positions, written in segments and never rewritten: what a search reads are its terms' partitions.

Postings are rows (term, field, id, tf, dl, positions) in partitions by a hash of the term,
so a query's terms are partition filters and the rest is skipped by the files' own
statistics, rows being sorted by term.  Adding documents writes a segment beside the
others; a deletion adds tombstones that name the segment whose rows no longer count, so a document
that is added again counts by its new rows alone.  Sums for scoring are small
files, one for each segment, and corrected by the tombstones.  A document's length in each field is
a posting of no term, in a partition of its own.

A row of null text has no words but counts as a document.  A term that fills many postings is spread
over files of its partition by document, more of them in larger segments.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.streaming.folders import new_folder

#: Partitions of terms, and how many documents of a segment ask for one more file in each.
BUCKETS, DOCS_PER_PART = 64, 250_000
#: The partition of the documents' lengths.
LENGTHS = -1
K1, B = 1.2, 0.75
_SCHEMAS = {
    "postings": "term string, field string, id {id}, tf int, dl int, positions array<int>, segment int, bucket int",
    "gone": "id {id}, field string, dl int, segment int",
}


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def _postings() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows (id, field, w) to (id, field, term, dl, tf, positions): one for each term of a row, and one without term for the row itself."""

    def run(batches):
        for batch in batches:
            ids, fields, w = batch.columns
            dl = w.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
            row = np.repeat(np.arange(len(dl)), dl)
            at = (np.arange(len(row)) - np.repeat(np.cumsum(dl, dtype=np.int64) - dl, dl)).astype(np.int32)
            coded = w.flatten().dictionary_encode()
            key = row * (len(coded.dictionary) + 1) + coded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            ends = np.append(first, len(order)).astype(np.int32)
            places = pa.ListArray.from_arrays(pa.array(ends), pa.array(at[order]))
            own, rest = row[order[first]], len(dl)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([ids.take(pa.array(own)), ids]),
                    pa.concat_arrays([fields.take(pa.array(own)), fields]),
                    pa.concat_arrays([coded.dictionary.take(coded.indices.take(pa.array(order[first]))), pa.nulls(rest, coded.dictionary.type)]),
                    pa.array(np.concatenate([dl[own], dl])),
                    pa.array(np.concatenate([np.diff(ends), np.zeros(rest, np.int32)]).astype(np.int32)),
                    pa.concat_arrays([places, pa.nulls(rest, places.type)]),
                ],
                names=["id", "field", "term", "dl", "tf", "positions"],
            )

    return run


class WordIndex:
    """An index in ``folder``; ``kind`` is the documents' id type, ``fields`` the columns they are searched by."""

    def __init__(self, spark: SparkSession, folder: str, fields: list[str], kind: str = "long", buckets: int = BUCKETS):
        self.spark, self.folder, self.fields, self.kind, self.buckets = spark, folder.rstrip("/"), fields, kind, buckets

    def _bucket(self, term: Column) -> Column:
        return (F.crc32(F.encode(term, "UTF-8")) % self.buckets).cast("int")

    def _path(self, part: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, part: str) -> list[str]:
        path, system = self._path(part)
        return [x.getPath().getName() for x in system.listStatus(path)] if system.exists(path) else []

    def _read(self, part: str, *under: str) -> DataFrame:
        """A part of the index, or the folders under it; empty if there are none."""
        schema = _SCHEMAS[part].format(id=self.kind)
        paths = [f"{self.folder}/{part}/{u}" for u in under] or ([f"{self.folder}/{part}"] if self._names(part) else [])
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{part}").parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _lengths(self, *segments: int) -> DataFrame:
        """(id, field, dl, segment) of every document of some segments."""
        under = [f"segment={s}/bucket={LENGTHS}" for s in segments if f"bucket={LENGTHS}" in self._names(f"postings/segment={s}")]
        rows = self._read("postings", *under) if under else self.spark.createDataFrame([], _SCHEMAS["postings"].format(id=self.kind))
        return rows.select("id", "field", "dl", "segment")

    def _segments(self) -> dict[int, dict[str, list[int]]]:
        """(documents, words) by field of each finished segment."""
        out = {}
        for name in self._names("sums"):
            if name.isdigit():
                path, system = self._path(f"sums/{name}")
                source = system.open(path)
                out[int(name)] = json.loads(bytes(source.readAllBytes()))
                source.close()
        return out

    def add(self, docs: DataFrame, id: str) -> int:
        """Write ``docs`` as a new segment; its sums come last and make it count."""
        segment = max(self._segments(), default=-1) + 1
        parts = -(-docs.count() // DOCS_PER_PART) or 1
        each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), words(F.coalesce(F.col(f), F.lit(""))).alias("w")) for f in self.fields)))
        split = docs.select(F.col(id).alias("id"), each.alias("f")).select("id", "f.field", "f.w")
        # a document's terms are told by its own task, so postings are moved and not words
        found = split.mapInArrow(_postings(), f"id {self.kind}, field string, term string, dl int, tf int, positions array<int>")
        placed = found.withColumn("bucket", F.when(F.col("term").isNull(), LENGTHS).otherwise(self._bucket(F.col("term"))))
        dealt = placed.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(parts))).sortWithinPartitions("bucket", "term", "field")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/postings/segment={segment}")
        sums = self._lengths(segment).groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("words")).collect()
        path, system = self._path(f"sums/{segment}")
        out = system.create(path, False)
        out.write(bytearray(json.dumps({r["field"]: [r["n"], r["words"]] for r in sums}).encode()))
        out.close()
        return segment

    def delete(self, ids: DataFrame, id: str) -> None:
        """From now on the rows these documents have don't count."""
        own = self._lengths(*self._segments()).join(ids.select(F.col(id).alias("id")).distinct(), "id", "left_semi")
        fresh = own.join(self._read("gone").select("id", "field", "segment"), ["id", "field", "segment"], "left_anti")
        fresh.write.mode("append").parquet(f"{self.folder}/gone")

    def postings(self, terms: list[str]) -> DataFrame:
        """The rows of ``terms`` that count."""
        buckets = sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})
        there = {s: set(self._names(f"postings/segment={s}")) for s in self._segments()}
        under = [f"segment={s}/bucket={b}" for s, names in there.items() for b in buckets if f"bucket={b}" in names]
        if not under:
            return self.spark.createDataFrame([], _SCHEMAS["postings"].format(id=self.kind))
        found = self._read("postings", *under).where(F.col("bucket").isin(*buckets) & F.col("term").isin(*terms))
        return found.join(self._read("gone").select("id", "segment").distinct(), ["id", "segment"], "left_anti") if self._names("gone") else found

    def totals(self) -> dict[str, tuple[int, float]]:
        """(documents, mean length) of each field."""
        total: dict[str, list[int]] = {}
        for own in self._segments().values():
            for field, (n, words) in own.items():
                before = total.get(field, [0, 0])
                total[field] = [before[0] + n, before[1] + words]
        if self._names("gone"):
            for r in self._read("gone").groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("words")).collect():
                total[r["field"]] = [total[r["field"]][0] - r["n"], total[r["field"]][1] - r["words"]]
        return {f: (n, words / n if n else 0.0) for f, (n, words) in total.items()}

    def scores(self, terms: list[str]) -> DataFrame:
        """(id, any, phrase): textbook BM25 summed over fields, of the terms and of their phrase, for documents with a term."""
        terms = list(dict.fromkeys(terms))
        found = self.postings(terms)
        total = self.totals()
        df = {(r["field"], r["term"]): r["n"] for r in found.groupBy("field", "term").agg(F.count(F.lit(1)).alias("n")).collect()}
        cell = {(f, t): (f"tf{i}_{k}", f"at{i}_{k}") for i, f in enumerate(self.fields) for k, t in enumerate(terms)}
        here = lambda f, t: (F.col("field") == f) & (F.col("term") == t)
        wide = found.groupBy("id").agg(
            *(F.max(F.when(F.col("field") == f, F.col("dl"))).alias(f"dl{i}") for i, f in enumerate(self.fields)),
            *(x for (f, t), (tf, at) in cell.items() for x in (F.max(F.when(here(f, t), F.col("tf"))).alias(tf), F.first(F.when(here(f, t), F.col("positions")), ignorenulls=True).alias(at))),
        )

        def idf(f: str, t: str) -> float:
            n, seen = total.get(f, (0, 0.0))[0], df.get((f, t), 0)
            return F.log(F.lit(1 + (n - seen + 0.5) / (seen + 0.5)))

        def part(i: int, f: str, tf: Column) -> Column:
            mean = total.get(f, (0, 0.0))[1]
            return F.when(tf > 0, tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col(f"dl{i}") / (mean or 1.0)))).otherwise(F.lit(0.0))

        said = reduce(add, (idf(f, t) * part(i, f, F.col(cell[f, t][0])) for i, f in enumerate(self.fields) for t in terms))
        phrase = F.lit(0.0)
        if len(terms) > 1:
            for i, f in enumerate(self.fields):
                weight = reduce(add, (idf(f, t) for t in terms))
                phrase = phrase + weight * part(i, f, F.coalesce(self._in_a_row([F.col(cell[f, t][1]) for t in terms]), F.lit(0)))
        return wide.select("id", F.coalesce(said, F.lit(0.0)).alias("any"), F.coalesce(phrase, F.lit(0.0)).alias("phrase"))

    @staticmethod
    def _in_a_row(places: list[Column]) -> Column:
        """How often the terms of these positions follow each other."""

        def follows(p: Column) -> Column:
            return reduce(lambda a, b: a & b, (F.array_contains(x, p + k) for k, x in enumerate(places) if k))

        return F.size(F.filter(places[0], follows))

    def bm25(self, terms: list[str]) -> DataFrame:
        """(id, score) of each document that has a term."""
        return self.scores(terms).select("id", F.round("any", 6).alias("score"))


_kept: dict[tuple, WordIndex] = {}


def index_of(spark: SparkSession, name: str, docs: DataFrame, id: str, fields: list[str]) -> WordIndex:
    """The session's index of a table, built when it is first asked for and again if the table's files differ."""
    key = (spark.sparkContext.applicationId, name, tuple(fields), _state(spark, docs))
    if key not in _kept:
        index = WordIndex(spark, new_folder(spark, f"index-{name}"), fields, docs.schema[id].dataType.simpleString())
        index.add(docs, id)
        _kept[key] = index
    return _kept[key]


def _state(spark: SparkSession, docs: DataFrame) -> tuple:
    """Names, lengths and times of the files a table is read from."""
    out = []
    for file in sorted(docs.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        told = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        out.append((file, told.getLen(), told.getModificationTime()))
    return tuple(out)
