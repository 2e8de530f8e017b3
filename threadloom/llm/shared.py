"""The folder all machines share, and lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder URI under ``spark.checkpoint.dir``, on the session's default file system if it names none.

    Where the session names no such folder, a cluster's warehouse takes its place, and a
    local session's own temporary folder (as in tests).
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.startswith("local"):
        root = "file://" + tempfile.mkdtemp(prefix="spark-threadloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    root = root or spark.conf.get("spark.sql.warehouse.dir")
    if root.startswith("/"):
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
        root = f"file://{root}" if default.startswith("file:") else default.rstrip("/") + root
    if root.startswith("file:/") and not root.startswith("file://"):
        root = "file://" + root.removeprefix("file:")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: a lineage cut in compressed columns."""
    path = shared_dir(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_held: dict = {}


def held(key: object, build: Callable[[], object] | None = None) -> object:
    """What ``build`` makes, kept in this Python worker until another key is asked for.

    Workers outlive the tasks of one operator; without ``build`` the worker only lets go
    of what an earlier operator left in it.
    """
    if key not in _held:
        _held.clear()
        if build is None:
            return None
        _held[key] = build()
    return _held[key]


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Bound the bytes of an Arrow batch unless the session has a lower bound: rows alone say nothing where texts may be very long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).removesuffix("b")
    if now.isdigit() and int(now) > most:
        spark.conf.set(name, str(most))


def free_name(df: DataFrame, stem: str) -> str:
    """``stem``, or a variant that clashes with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem
