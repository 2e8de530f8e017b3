"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.cleaning import VALUE

def estimated_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def truncated(text: Column, most: int = 15000, head: int = 11000, tail: int = 4000) -> Column:
    """Head and tail around a mark where the text is too long."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(head)), F.lit("\n\n[...]\n\n"), F.right(text, F.lit(tail)))).otherwise(text)


def clipped(text: Column, most: int = 8000) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("... [clipped]"))).otherwise(text)


def value_tokens(text: Column) -> Column:
    """The distinct words that hold a digit, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(VALUE), F.lit(0))))
