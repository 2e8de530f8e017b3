"""All queries of the library by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from threadloom.plans import body_queries, corpus_queries, fact_queries, log_queries, mail_queries, message_queries, search_queries, sql_queries, store_queries, text_queries, upkeep_queries
from threadloom.streaming import windows

_MODULES = (body_queries, message_queries, fact_queries, mail_queries, sql_queries, store_queries, windows, text_queries, log_queries, search_queries, corpus_queries, upkeep_queries)
QUERIES: dict = {name: run for m in _MODULES for name, run in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
