"""The queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """Name → query and name → oracle SQL of every module with queries."""
    from tidemark.llm import queries  # noqa: F401

    return QUERIES, SQL
