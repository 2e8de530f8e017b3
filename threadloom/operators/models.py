"""Embedding and language models as injected functions: rows go to them in batches, and a bad item fails alone."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_embedder(dims: int = 16) -> Callable[[list[str]], list[list[float]]]:
    """A stand-in without a model: a unit vector drawn from the text's digest, the same everywhere."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.random.RandomState(int.from_bytes(hashlib.blake2b(t.encode(), digest_size=4).digest(), "little")).normal(size=dims)
            out.append((v / np.linalg.norm(v)).tolist())
        return out

    return embed


def called(df: DataFrame, column: str, function: Callable[[list[str]], list], result: str, kind: str, batch: int = 100) -> DataFrame:
    """``df`` with ``result`` and ``error`` of ``function`` over ``column``, ``batch`` items a call.

    If a call fails its items are tried one by one, so only those at fault have an error.
    A null item isn't sent: its result and error are null.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{result}` {kind}", "error string"])

    def tried(items: list[str]) -> list[tuple]:
        try:
            return [(x, None) for x in function(items)]
        except Exception as e:  # whatever the model raises is the item's error
            return [(None, str(e) or type(e).__name__)] if len(items) == 1 else [x for i in items for x in tried([i])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                told = [k for k, x in enumerate(part[column]) if x is not None]
                got: list[tuple] = [(None, None)] * len(part)
                for k, x in zip(told, tried([part[column].iloc[k] for k in told]) if told else [], strict=True):
                    got[k] = x
                yield part.assign(**{result: pd.Series([x for x, _ in got], index=part.index, dtype=object), "error": pd.Series([e for _, e in got], index=part.index, dtype=object)})

    return df.mapInPandas(run, schema)


def within_budget(df: DataFrame, text: str, spent: float, budget: float, per_million: float = 0.20) -> DataFrame:
    """Rows whose texts may still be embedded: estimated cost of all of them together, or none if it is over the budget."""
    cost = df.agg((F.sum(F.floor(F.length(text) / 4)) / 1e6 * per_million).alias("__cost"))
    return df.join(F.broadcast(cost)).where(F.coalesce("__cost", F.lit(0.0)) + spent <= budget).drop("__cost")
