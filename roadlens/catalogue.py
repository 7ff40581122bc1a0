"""Where queries are registered: each with its function and, where there is one, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roadlens import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None, *tables: str) -> Callable[[Query], Query]:
    """Registers a function under its name; ``tables`` are the domain tables that its SQL reads."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = A.with_tables(sql, *tables) if tables else sql
        return f

    return keep
