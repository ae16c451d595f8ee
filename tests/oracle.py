"""Compares a query with its oracle SQL: column names, row count and values in any order."""

from __future__ import annotations

import math
from pathlib import Path


def normal(v):  # noqa: ANN001, ANN201
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int | float):
        return round(float(v), 6)
    return str(v)


def rows(columns: list[str], data: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in data), key=repr)


def compare(spark, query, sql: str, sf_dir: str) -> None:  # noqa: ANN001
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(names), (sorted(df.columns), sorted(names))
    mine, theirs = rows(df.columns, df.collect()), rows(names, got.fetchall())
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    assert mine == theirs, next((a, b) for a, b in zip(mine, theirs) if a != b)
