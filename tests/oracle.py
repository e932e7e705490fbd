"""Compares a registered query with its SQL, order-insensitively."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(folder: str):
    db = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return db


def _norm(value):
    if isinstance(value, float):
        assert value != 0 or math.copysign(1, value) > 0, "negative zero"
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(((tuple(_norm(r[i]) for i in order)) for r in rows), key=repr)


def compare(df, db, sql: str):
    result = db.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names), (sorted(df.columns), sorted(names))
    expected = rows_of(names, result.fetchall())
    actual = rows_of(df.columns, df.collect())
    assert len(actual) == len(expected), (len(actual), len(expected))
    for a, e in zip(actual, expected):
        assert a == e, (a, e)
        assert [type(x) for x in a] == [type(x) for x in e], (a, e)
    return len(actual)
