from __future__ import annotations

import duckdb
import pytest


@pytest.fixture(scope="session")
def texts(sf):
    """Rows (doc_id, text) of the documents table."""
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()
