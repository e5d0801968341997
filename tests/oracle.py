"""Runs registered queries next to their SQL twins (DuckDB) and compares all values."""

from __future__ import annotations

import collections
import datetime
import decimal
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value: object) -> str:
    if value is None:
        return "\0null"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.9g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def normal(columns: list[str], rows: list) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, run, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    started = time.time()
    df = run(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    spent = time.time() - started
    if sql is None:
        return bool(rows), f"{name}: rows-only {len(rows)} rows {spent:.1f}s"
    started = time.time()
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    expected = result.fetchall()
    duck = time.time() - started
    if sorted(columns) != sorted(df.columns):
        return False, f"{name}: columns {sorted(df.columns)} != {sorted(columns)}"
    ours, theirs = normal(df.columns, rows), normal(columns, expected)
    if ours != theirs:
        left, right = collections.Counter(ours), collections.Counter(theirs)
        extra, missing = list((left - right).elements())[:3], list((right - left).elements())[:3]
        return False, f"{name}: {len(ours)} rows vs {len(theirs)}\n  ours only {str(extra)[:600]}\n  sql only {str(missing)[:600]}"
    return True, f"{name}: ok {len(rows)} rows spark {spent:.1f}s sql {duck:.1f}s"


def main(prefixes: list[str], sf_dir: str) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from chatterloom.session import build_session

    spark = build_session("oracle")
    con = connect(sf_dir)
    con.execute("SET threads=4")
    sql = entry.oracle_sql()
    failed = 0
    for name, run in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            good, message = compare(spark, con, name, run, sql.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on
            good, message = False, f"{name}: {type(error).__name__} {str(error)[:1500]}"
        failed += not good
        print(("" if good else "FAIL ") + message, flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    import os

    raise SystemExit(main(sys.argv[1:], os.environ.get("SF_DIR", "/root/testdata/sf0.01")) > 0)
