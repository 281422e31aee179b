"""Row-for-row comparison of a Spark frame with a DuckDB statement."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime
from pathlib import Path

import duckdb


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"create view {file.stem} as select * from '{file}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    return value


def as_bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(frame, connection: duckdb.DuckDBPyConnection, sql: str) -> int:
    """Assert equal columns and equal rows; returns the number of rows."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(names)
    expected, actual = as_bag(names, result.fetchall()), as_bag(frame.columns, frame.collect())
    missing, extra = expected - actual, actual - expected
    assert not missing and not extra, (
        f"{sum(missing.values())} missing, {sum(extra.values())} extra of "
        f"{sum(expected.values())}; columns {sorted(names)}\n"
        f"missing {sorted(map(str, missing))[:3]}\nextra {sorted(map(str, extra))[:3]}")
    return sum(actual.values())
