"""Run a catalog query and its SQL side by side."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = [
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        if Path(f"{sf_dir}/{table}.parquet").exists():
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows), key=lambda row: tuple(map(repr, row))
    )


def spark_rows(df):
    return _rows(df.columns, [tuple(row) for row in df.collect()])


def duck_rows(connection, sql: str):
    result = connection.execute(sql)
    return _rows([column[0] for column in result.description], result.fetchall())


def difference(df, connection, sql: str) -> str | None:
    """What differs, or None."""
    names, rows = spark_rows(df)
    duck_names, expected = duck_rows(connection, sql)
    if names != duck_names:
        return f"columns {names} instead of {duck_names}"
    if rows != expected:
        extra, missing = set(rows) - set(expected), set(expected) - set(rows)
        return (
            f"{len(rows)} rows instead of {len(expected)}; {len(extra)} extra like {sorted(extra, key=repr)[:2]}, "
            f"{len(missing)} missing like {sorted(missing, key=repr)[:2]}"
        )
    return None
