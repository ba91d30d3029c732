"""Comparing a Spark result with a DuckDB one."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    return value


def rows_of(rows, columns, names) -> Counter:
    places = [names.index(c) for c in columns]
    return Counter(tuple(_plain(row[i]) for i in places) for row in rows)


def difference(df, connection, sql: str) -> list[str]:
    """What differs; empty when names, types and rows are the same."""
    cursor = connection.execute(sql)
    names = [c[0] for c in cursor.description]
    kinds = {c[0]: str(c[1]) for c in cursor.description}
    expected = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)}, expected {sorted(names)}"]
    found = []
    for field in df.schema.fields:
        kind = TYPES.get(field.dataType.simpleString(), field.dataType.simpleString())
        if kind != kinds[field.name]:
            found.append(f"{field.name} is {kind}, expected {kinds[field.name]}")
    columns = sorted(names)
    ours, theirs = rows_of(df.collect(), columns, df.columns), rows_of(expected, columns, names)
    if ours != theirs:
        found.append(f"only in Spark {list((ours - theirs).elements())[:3]}")
        found.append(f"only in DuckDB {list((theirs - ours).elements())[:3]}")
    return found
