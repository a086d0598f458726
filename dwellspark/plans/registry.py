"""Registry of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dwellspark.fixtures import DWELLING_CTES

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; `sql` is its independent twin for the oracle."""
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


def over_sales(body: str, *ctes: str) -> str:
    """SQL text with the derived `dwelling` table (and further CTEs) in scope."""
    return "WITH " + ", ".join((DWELLING_CTES, *ctes)) + "\n" + body
