"""Run a named query on Spark and its SQL on DuckDB, and compare all rows."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return int(value) if value.is_integer() else round(value, 6)
    if value is not None and not isinstance(value, (int, str)):
        return _plain(float(value))
    return value


def differences(spark_rows, sql_relation) -> str | None:
    """None if both hold the same rows under the same column names."""
    names = sorted(sql_relation.columns)
    expected = Counter(tuple(_plain(r[sql_relation.columns.index(n)]) for n in names) for r in sql_relation.fetchall())
    columns = sorted(spark_rows.columns)
    if columns != names:
        return f"columns {columns} against {names}"
    found = Counter(tuple(_plain(r[n]) for n in names) for r in spark_rows.collect())
    if found == expected:
        return None
    extra, missing = list((found - expected).items())[:3], list((expected - found).items())[:3]
    return f"{sum(found.values())} rows against {sum(expected.values())}; only Spark {extra}; only SQL {missing}"
