"""Run a registered query and its SQL twin on the same tables and compare all values."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    made = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(made, key=repr)


def kind(value):
    return "number" if isinstance(value, (int, float)) and not isinstance(value, bool) else type(value).__name__


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty when names, row count, value kinds and values agree."""
    names, left = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    other, right = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if names != other:
        return [f"columns {names} != {other}"]
    found = []
    if len(left) != len(right):
        found.append(f"rows {len(left)} != {len(right)}")
    for a, b in zip(left, right, strict=False):
        if a != b or any(isinstance(x, float) != isinstance(y, float) for x, y in zip(a, b, strict=True)):
            found.append(f"spark {dict(zip(names, a, strict=True))} != sql {dict(zip(names, b, strict=True))}")
            if len(found) > 4:
                break
    return found
