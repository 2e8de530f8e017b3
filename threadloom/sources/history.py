"""A stream source of a mailbox: what is new since a history id, and a sweep of recent mail where that history is gone.

A mailbox is a folder of Parquet files of messages with ascending ``history_id``, and a
file ``_oldest`` with the least history id it still tells changes from.  The offset is
the last history id seen.  If changes since then aren't told any more, the batch holds all mail
of the last ``SWEEP`` days instead, so some of it comes twice: keep it by ``id`` (``stored``).
Mail older than that which came in while nobody followed is not found this way; a batch over the
mailbox (``stored`` again) makes it good.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SWEEP = 14


class MailHistory(DataSource):
    """``spark.readStream.format("mail_history").schema(...).option("path", mailbox)``"""

    @classmethod
    def name(cls) -> str:
        return "mail_history"

    def schema(self) -> str:
        return "id string, thread_id string, user_id string, date string, history_id long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"], schema.names, int(self.options.get("sweep_days", SWEEP)))


@dataclass
class _Part(InputPartition):
    """The rows of one file with history ids in (after, upto], or from a date on."""

    file: str
    after: int
    upto: int
    since: str | None


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, columns: list[str], days: int):
        self.path, self.columns, self.days = path, columns, days

    def _files(self) -> tuple[fs.FileSystem, list[ds.ParquetFileFragment]]:
        system, root = fs.FileSystem.from_uri(self.path)
        return system, list(ds.dataset(root, format="parquet", filesystem=system).get_fragments())

    def initialOffset(self) -> dict:
        return {"history": -1}

    def latestOffset(self) -> dict:
        _, files = self._files()
        return {"history": max((_ends(f, "history_id")[1] for f in files), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        system, files = self._files()
        told = system.get_file_info(f"{fs.FileSystem.from_uri(self.path)[1]}/_oldest")
        oldest = int(system.open_input_file(told.path).read()) if told.is_file else 0
        since = None
        if -1 < start["history"] < oldest - 1:
            newest = max(e[1] for f in files if (e := _ends(f, "date", None))[1] is not None)
            since = (datetime.datetime.fromisoformat(newest) - datetime.timedelta(days=self.days)).isoformat()
        after = -1 if since else start["history"]
        return [_Part(f.path, after, end["history"], since) for f in files if _ends(f, "history_id")[1] > after]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        wanted = (pc.field("history_id") > part.after) & (pc.field("history_id") <= part.upto)
        if part.since:
            wanted = wanted & (pc.field("date") >= part.since)
        yield from ds.dataset(part.file, format="parquet", filesystem=system).to_batches(columns=self.columns, filter=wanted)

    def commit(self, end: dict) -> None:
        """The mailbox itself decides how long it tells changes."""


def _ends(file: ds.ParquetFileFragment, column: str, none: object = -1):
    """(least, greatest) value of a column by a file's footer; ``none`` twice where it tells nothing."""
    at = file.physical_schema.names.index(column)
    groups = [file.metadata.row_group(k).column(at).statistics for k in range(file.metadata.num_row_groups)]
    found = [s for s in groups if s is not None and s.has_min_max]
    return (min(s.min for s in found), max(s.max for s in found)) if found else (none, none)


def follow(spark: SparkSession, mailbox: str, stored: str, checkpoint: str, schema: str) -> None:
    """Store what has come into the mailbox since the last stop, each id once, and return."""
    spark.dataSource.register(MailHistory)

    def batch(rows: DataFrame, number: int) -> None:
        store(rows, stored)

    stream = spark.readStream.format("mail_history").schema(schema).option("path", mailbox).load()
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def store(rows: DataFrame, stored: str) -> None:
    """Append the rows whose id isn't stored yet."""
    own = rows.dropDuplicates(["id"])
    try:
        there = rows.sparkSession.read.schema(rows.schema).parquet(stored)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = None
    (own if there is None else own.join(there.select("id"), "id", "left_anti")).select(rows.columns).write.mode("append").parquet(stored)


def forget(mailbox: str, oldest: int) -> None:
    """From now on the mailbox tells changes from ``_oldest`` on only."""
    system, root = fs.FileSystem.from_uri(mailbox)
    with system.open_output_stream(f"{root}/_oldest") as out:
        out.write(str(oldest).encode())
