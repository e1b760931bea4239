"""Registry of runnable queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    """Register a query; `needs` names the shared table definitions its SQL starts from."""
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            from .tables_sql import with_clause
            ORACLES[name] = with_clause(needs) + sql
        return fn
    return wrap
