"""How the query modules register a query with the DuckDB SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadloom.sources.mail import given, with_views


class Registry:
    """Queries and their SQL by name."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None, *views: str):
        """Register the decorated function; ``views`` of the mail model are put in front of ``sql``, which may go on with a comma."""

        def add(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracle[f.__name__] = with_views(sql, *views) if views else sql
            return f

        return add

    def over(self, given_sql: str, sql: str, *views: str):
        """Register a function of one table, ``given_sql`` over base tables and ``views``; ``sql`` reads that table as ``g``.

        Both engines make ``g`` by the same text; what is compared is what becomes of it.
        """

        def add(f):
            self.queries[f.__name__] = lambda spark, sf: f(given(spark, sf, given_sql, *views))
            self.oracle[f.__name__] = with_views(f", g AS ({given_sql}) {sql}", *views) if views else f"WITH g AS ({given_sql}) {sql}"
            return f

        return add
