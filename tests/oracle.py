"""Compare a query with its SQL: same columns, same rows, order aside."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        return "None" if math.isnan(value) else repr(float(value))
    if isinstance(value, int):
        return repr(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return str(value)


def _kind(value):
    return "bool" if isinstance(value, bool) else "float" if isinstance(value, (float, decimal.Decimal)) else type(value).__name__


def compare(df, connection, sql) -> str | None:
    """None if equal, else what differs."""
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    ours = [tuple(r[c] for c in order) for r in df.select(*[f"`{c}`" for c in order]).collect()]
    at = [names.index(c) for c in order]
    theirs = [tuple(r[i] for i in at) for r in theirs]
    for i, c in enumerate(order):
        kinds = [{_kind(r[i]) for r in rows if r[i] is not None} for rows in (ours, theirs)]
        if kinds[0] and kinds[1] and kinds[0] != kinds[1]:
            return f"type of {c}: {kinds[0]} against {kinds[1]}"
    a = sorted(tuple(map(_plain, r)) for r in ours)
    b = sorted(tuple(map(_plain, r)) for r in theirs)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}; e.g. {list(set(a) ^ set(b))[:4]}"
    differ = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(differ)} of {len(a)} rows differ, e.g. {differ[:2]}" if differ else None
