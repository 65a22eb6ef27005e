"""Every registered query against its oracle SQL."""

from __future__ import annotations

import duckdb
import pytest

from tidemark.plans.registry import load_all
from tools.check import TABLES, compare

ENTRIES = load_all()


@pytest.fixture(scope="module")
def connection(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query(spark, connection, sf, name):
    result = compare(spark, connection, ENTRIES[name], sf)
    assert not result.startswith("FAIL"), result
    assert "types" not in result, result


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
