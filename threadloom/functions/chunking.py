"""Long texts in chunks, as an Arrow function of a column and as table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

TOKENS = 500


class _Packer:
    """Units one after another, closed before they pass ``most`` tokens; the last unit is carried over as context."""

    def __init__(self, most: int):
        self.most, self.out, self.held, self.size = most, [], [], 0

    def put(self, unit: str, between: str) -> None:
        if self.held and self.size + len(unit) // 4 > self.most:
            self.out.append(between.join(self.held))
            del self.held[:-1]
            self.size = len(self.held[0]) // 4
        self.held.append(unit)
        self.size += len(unit) // 4

    def close(self) -> None:
        if self.held:
            self.out.append("\n\n".join(self.held))
        self.held, self.size = [], 0


def chunked(text: str, most: int = TOKENS) -> list[str]:
    """``text`` in chunks of about ``most`` tokens: by paragraphs, and by sentences where a paragraph is longer than that."""
    if len(text) // 4 <= most:
        return [text]
    packer = _Packer(most)
    for paragraph in (p.strip() for p in text.split("\n\n")):
        if not paragraph:
            continue
        if len(paragraph) // 4 <= most:
            packer.put(paragraph, "\n\n")
            continue
        packer.close()
        for sentence in paragraph.replace(". ", ".\n").split("\n"):
            packer.put(sentence, " ")
    packer.close()
    return packer.out or [text]


def chunks(text: Column, most: int = TOKENS) -> Column:
    """Array of a text's chunks; null for null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: None if t is None else chunked(t, most))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<string>")(text)


@F.udtf(returnType="place int, chunk string")
class ChunkText:
    """``SELECT t.* FROM messages, LATERAL chunk_text(body_text) t``: a row for each chunk."""

    def eval(self, text: str):
        for k, chunk in enumerate(chunked(text) if text is not None else ()):
            yield k, chunk


@F.udtf(returnType="place int, url string")
class ExtractUrls:
    """A row for each distinct link of a text without punctuation at its end, in order."""

    def eval(self, text: str):
        import re

        found = re.findall(r"https?://[^\s<>\"']+", text or "", re.IGNORECASE)
        yield from enumerate(dict.fromkeys(u.rstrip(".,;:!?\"'>") for u in found))


def register(spark: SparkSession) -> None:
    """Make ``chunk_text`` and ``extract_urls`` known to SQL."""
    spark.udtf.register("chunk_text", ChunkText)
    spark.udtf.register("extract_urls", ExtractUrls)
