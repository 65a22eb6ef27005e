"""Compare registered queries with their oracle SQL: ``python tools/check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from tidemark.plans.registry import load_all
from tidemark.session import get_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def cell(v):
    if isinstance(v, decimal.Decimal):
        return f"{v.normalize():f}"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool):
        return str(v)
    return str(v)


def rows_of(table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return sorted(tuple(cell(v) for v in row) for row in zip(*columns))


def compare(spark, connection, entry, sf_dir) -> str:
    started = time.time()
    got = entry.run(spark, sf_dir).toArrow()
    took = time.time() - started
    if entry.sql is None:
        return f"rows-only {got.num_rows} rows {took:.2f}s"
    want = connection.execute(entry.sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"FAIL columns {sorted(got.column_names)} vs {sorted(want.column_names)}"
    a, b = rows_of(got), rows_of(want)
    types = {
        n: (str(got.schema.field(n).type), str(want.schema.field(n).type))
        for n in got.column_names
        if str(got.schema.field(n).type) != str(want.schema.field(n).type)
    }
    note = f" types {types}" if types else ""
    if a != b:
        only_a = [r for r in a if r not in set(b)][:3]
        only_b = [r for r in b if r not in set(a)][:3]
        return f"FAIL {len(a)} vs {len(b)} rows; spark {only_a} oracle {only_b}{note}"
    return f"ok {len(a)} rows {took:.2f}s{note}"


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    entries = load_all()
    names = sys.argv[2:] or list(entries)
    spark = get_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = 0
    times = []
    for name in names:
        try:
            result = compare(spark, connection, entries[name], sf_dir)
        except Exception as error:  # report and go on with the next query
            result = "FAIL " + str(error).split("\n")[0][:400]
        bad += result.startswith("FAIL")
        if os.environ.get("TIMES"):
            times.append((float(result.rsplit("s", 1)[0].split()[-1]) if "rows " in result and "FAIL" not in result else 0.0, name))
        if not result.startswith("ok") or "types" in result or len(sys.argv) > 2:
            print(f"{name}: {result}", flush=True)
    for took, name in sorted(times, reverse=True)[:40]:
        print(f"{took:.2f} {name}")
    print(f"{len(names)} queries, {bad} failed")
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
