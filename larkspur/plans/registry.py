"""Queries by name, each with the SQL that must give the same rows (None: SQL can't express it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    """Registers a query. views: common table expressions that its SQL starts with."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = (f"with recursive {', '.join(views)}\n" if views else "") + sql
        return f

    return put
