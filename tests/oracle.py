"""Compare Spark results with DuckDB results: columns, row count, values."""

from __future__ import annotations

import datetime
import math

import duckdb

from lotwise.plans.views import TABLES


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return "NULL" if v is None else str(v)


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(frame, con, sql: str) -> str:
    """Empty text when equal, else what differs."""
    spark_columns, spark_rows = _table(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    columns, rows = _table(names, cursor.fetchall())
    if spark_columns != columns:
        return f"columns {spark_columns} against {columns}"
    if len(spark_rows) != len(rows):
        ours, theirs = set(spark_rows), set(rows)
        extra = sorted(ours - theirs)[:3], sorted(theirs - ours)[:3]
        return f"{len(spark_rows)} rows against {len(rows)}; {extra}"
    wrong = [(a, b) for a, b in zip(spark_rows, rows) if a != b]
    return f"{len(wrong)} rows differ, first: {wrong[:2]}" if wrong else ""
