"""Run registered queries next to their SQL and compare row counts, types and values."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}


def duck(folder: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value + 0.0, 9))
    if isinstance(value, (datetime.date, decimal.Decimal)):
        return str(value)
    return repr(value)


def compare(spark, connection, folder: str, name: str, function, sql: str | None) -> str:
    """'' when equal (or when there is no SQL and the query runs), else what differs."""
    df = function(spark, folder)
    rows = df.collect()
    if sql is None:
        return "" if df.columns else "no columns"
    result = connection.execute(sql)
    columns = [c[0] for c in result.description]
    kinds = {c[0]: str(c[1]) for c in result.description}
    expected = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    types = {c: (k, kinds[c]) for c, k in df.dtypes if KINDS.get(k, k) != kinds[c]}
    if len(rows) != len(expected):
        return f"rows {len(rows)} / {len(expected)} {types}"
    order = sorted(columns)
    left = sorted("|".join(_cell(r[c]) for c in order) for r in rows)
    index = [columns.index(c) for c in order]
    right = sorted("|".join(_cell(r[i]) for i in index) for r in expected)
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} of {len(left)} differ, e.g. {bad[0][0][:300]} / {bad[0][1][:300]} {types}"
    return f"types {types}" if types else ""


def main(folder: str, only: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from awardsift.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection, checks, failed = duck(folder), oracle_sql(), 0
    for name, function in queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            problem = compare(spark, connection, folder, name, function, checks.get(name))
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:32s} {time.time() - start:6.2f}s {'' if name in checks else '(rows only) '}{problem}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
