"""Registry of runnable queries, each with its oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.fixtures import FIXTURE_SQL

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    ids: tuple[str, ...]
    run: Plan
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def oracle(fixtures: str, body: str) -> str:
    """Oracle text: the named fixtures as CTEs, then ``body`` (more CTEs and a SELECT)."""
    parts = [f"{name} AS ({FIXTURE_SQL[name]})" for name in fixtures.split()]
    body = body.strip()
    if body.upper().startswith("SELECT"):
        return ("WITH RECURSIVE " + ", ".join(parts) + " " if parts else "") + body
    return "WITH RECURSIVE " + ", ".join([*parts, body])


def plan(name: str, ids: str, fixtures: str = "", sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a query under ``name``; ``ids`` are the inventory rows it covers."""

    def register(run: Plan) -> Plan:
        if name in ENTRIES:
            raise ValueError(f"query {name} registered twice")
        ENTRIES[name] = Entry(name, tuple(ids.split()), run, oracle(fixtures, sql) if sql else None)
        return run

    return register


def load_all() -> dict[str, Entry]:
    from tidemark.plans import (  # noqa: F401
        changes,
        etl,
        governance,
        health,
        jobs,
        reconciliation,
        relational,
        streams,
        telemetry,
    )

    return ENTRIES
