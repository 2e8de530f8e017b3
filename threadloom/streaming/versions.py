"""Tables in buckets that are replaced a few buckets at a time, seen whole or not at all.

A table is a folder of versions and a folder of pointers.  A writer puts the buckets that
change into a folder of its own; pointer ``n``, one small file, says for every bucket which
folder has it, and is created last, atomically, only if no other writer has made it.  The
pointer of the largest number is the table.  So a reader sees one version, a failed
write leaves nothing that is read, two writers can't undo each other, and buckets that
don't change are never written again.

Clean-up removes what none of the newest pointers names; readers of an older one have until then.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "__bucket"


@dataclass
class Pointer:
    """What a version consists of: the version of each bucket, and the batches of streams that are in it."""

    number: int = -1
    buckets: dict[int, str] = field(default_factory=dict)
    done: dict[str, int] = field(default_factory=dict)
    schema: str | None = None

    def made_by(self, bucket: int) -> int:
        """The number of the version that wrote a bucket."""
        return int(self.buckets[bucket].partition("-")[0])


class Taken(RuntimeError):
    """Another writer was first."""


class Versions:
    """One table's versions under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, sub: str) -> list[str]:
        at = self._path(f"{self.folder}/{sub}")
        return [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def pointer(self) -> Pointer:
        """The newest pointer; before the first an empty one."""
        numbers = [int(n) for n in self._names("pointers") if n.isdigit()]
        if not numbers:
            return Pointer()
        number = max(numbers)
        source = self._fs.open(self._path(f"{self.folder}/pointers/{number}"))
        try:
            told = json.loads(bytes(source.readAllBytes()))
        finally:
            source.close()
        return Pointer(number, {int(b): v for b, v in told["buckets"].items()}, told["done"], told["schema"])

    def read(self, pointer: Pointer, buckets: list[int] | None = None) -> DataFrame | None:
        """The table of a pointer, or some of its buckets; None where it has none of them."""
        chosen = {b: v for b, v in pointer.buckets.items() if buckets is None or b in buckets}
        if not chosen:
            return None
        paths = [f"{self.folder}/data/{v}/{BUCKET}={b}" for b, v in sorted(chosen.items())]
        return self.spark.read.schema(StructType.fromJson(json.loads(pointer.schema))).parquet(*paths)

    def current(self) -> tuple[int, DataFrame] | None:
        """(version, table), or None before the first."""
        now = self.pointer()
        table = self.read(now)
        return None if table is None else (now.number, table)

    def publish(self, rows: DataFrame, bucket: F.Column, touched: list[int], before: Pointer, source: str | None = None, batch: int = -1, spread: str | None = None) -> Pointer:
        """Make the version after ``before``: ``rows`` are all rows of the ``touched`` buckets, the others stay as they are.

        A touched bucket without rows is dropped.  A bucket is one file, or as many as its
        size asks for, dealt by the column ``spread``.  ``source`` and ``batch`` are kept beside the version.
        """
        number = before.number + 1
        home = f"{number}-{uuid.uuid4().hex[:12]}"
        marked = rows.withColumn(BUCKET, bucket.cast("int"))
        dealt = marked.repartition(BUCKET, spread) if spread else marked.repartition(max(1, min(len(touched), 200)), BUCKET)
        dealt.write.partitionBy(BUCKET).parquet(f"{self.folder}/data/{home}")
        made = {int(n.partition("=")[2]) for n in self._names(f"data/{home}") if n.startswith(f"{BUCKET}=")}
        buckets = {b: v for b, v in before.buckets.items() if b not in touched} | dict.fromkeys(made, home)
        done = before.done | ({source: batch} if source is not None else {})
        told = json.dumps({"buckets": buckets, "done": done, "schema": rows.schema.json()})
        self._create(number, told)
        return Pointer(number, buckets, done, rows.schema.json())

    def _create(self, number: int, told: str) -> None:
        """The pointer's file under its name only when it is whole, and only if there is none of that name."""
        home, draft = f"{self.folder}/pointers", self._path(f"{self.folder}/drafts/{number}-{uuid.uuid4().hex}")
        self._fs.mkdirs(self._path(home))
        out = self._fs.create(draft, True)
        out.write(bytearray(told.encode()))
        out.close()
        target = self._path(f"{home}/{number}")
        try:
            if not self._put(draft, target):
                raise Taken(f"version {number} was made by another writer")
        finally:
            self._fs.delete(draft, False)

    def _put(self, draft, target) -> bool:
        """Give a file its name unless something has it; HDFS renames so, a local disk makes a link so."""
        if self._fs.getUri().getScheme() != "file":
            return self._fs.rename(draft, target)
        nio = self.spark._jvm.java.nio.file
        local = lambda p: nio.Path.of(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self.spark._jvm.java.lang.String, 0))
        try:
            nio.Files.createLink(local(target), local(draft))
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            return False
        return True

    def clean(self, keep: int = 1) -> list[str]:
        """Remove pointers older than the newest ``keep + 1``, and bucket folders that none of those names; says what went."""
        numbers = sorted((int(n) for n in self._names("pointers") if n.isdigit()), reverse=True)
        kept, gone = numbers[: keep + 1], []
        if not kept:
            return gone
        named = set()
        for n in kept:
            source = self._fs.open(self._path(f"{self.folder}/pointers/{n}"))
            named |= {(v, int(b)) for b, v in json.loads(bytes(source.readAllBytes()))["buckets"].items()}
            source.close()
        for n in numbers[keep + 1 :]:
            self._fs.delete(self._path(f"{self.folder}/pointers/{n}"), False)
        for name in self._names("data"):
            if int(name.partition("-")[0]) > kept[0]:
                continue  # a writer may be at it
            subs = [s for s in self._names(f"data/{name}") if s.startswith(f"{BUCKET}=")]
            unnamed = [s for s in subs if (name, int(s.partition("=")[2])) not in named]
            for sub in unnamed:
                self._fs.delete(self._path(f"{self.folder}/data/{name}/{sub}"), True)
                gone.append(f"{name}/{sub}")
            if len(unnamed) == len(subs):
                self._fs.delete(self._path(f"{self.folder}/data/{name}"), True)
        return gone


class Reader:
    """A table that is looked at again and again: it changes over to a newer version when one has been published."""

    def __init__(self, versions: Versions):
        self.versions, self.number, self._table = versions, -1, None

    def table(self) -> DataFrame | None:
        now = self.versions.pointer()
        if now.number != self.number:
            self.number, self._table = now.number, self.versions.read(now)
        return self._table


def upsert_buckets(versions: Versions, fresh: DataFrame, keys: list[str], buckets: int, merge: Callable[[DataFrame | None, DataFrame], DataFrame], source: str | None = None, batch: int = -1, attempts: int = 5) -> Pointer | None:
    """Merge ``fresh`` rows into the buckets their keys fall in; a batch of ``source`` that is in the table already is left alone.

    ``merge(old, fresh)`` gives a bucket's new rows.  When another writer was first, the
    merge is done again on what that writer made.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))
    touched = sorted(r[0] for r in fresh.select(bucket.cast("int").alias("b")).distinct().collect())
    for _ in range(attempts):
        before = versions.pointer()
        if source is not None and before.done.get(source, -1) >= batch:
            return None
        if not touched:
            return before
        try:
            return versions.publish(merge(versions.read(before, touched), fresh), bucket, touched, before, source, batch)
        except Taken:
            continue
    raise Taken("other writers were first each time")
