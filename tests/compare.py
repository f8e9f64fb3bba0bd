"""Spark rows against DuckDB rows, columns by name, rows in any order."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def ordered(columns: list[str], rows: list[tuple]) -> list[tuple]:
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(row[i]) for i in at) for row in rows), key=lambda r: tuple((v is None, type(v).__name__, v if v is not None else 0) for v in r))


def duck_rows(connection, sql: str) -> tuple[list[str], list[str], list[tuple]]:
    relation = connection.sql(sql)
    return list(relation.columns), [str(t) for t in relation.types], relation.fetchall()


DUCK_TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
}


def differences(frame, connection, sql: str) -> list[str]:
    columns, types, expected = duck_rows(connection, sql)
    actual = [tuple(r) for r in frame.collect()]
    if sorted(columns) != sorted(frame.columns):
        return [f"columns {sorted(frame.columns)} != {sorted(columns)}"]
    found = []
    spark_types = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    for name, kind in zip(columns, types):
        if DUCK_TYPES.get(spark_types[name]) != kind:
            found.append(f"type of {name}: {spark_types[name]} != {kind}")
    if len(actual) != len(expected):
        return found + [f"rows {len(actual)} != {len(expected)}"]
    left, right = ordered(frame.columns, actual), ordered(columns, expected)
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    return found + [f"{len(wrong)} rows differ, first {a} != {b}" for a, b in wrong[:1]]
