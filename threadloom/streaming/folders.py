"""Where streams keep their checkpoints and tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one the session names, else in the warehouse; a local session may use its own temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.startswith("local"):
        return "file://" + tempfile.mkdtemp(prefix=f"spark-threadloom-{name}-")
    return f"{(root or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{name}-{uuid.uuid4().hex}"
