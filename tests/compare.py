"""Equality of a Spark result with a DuckDB statement over the same tables."""

from __future__ import annotations

import os

import duckdb


def _value(x):
    if isinstance(x, float):
        return ("f", round(x, 6) + 0.0)
    if isinstance(x, (list, tuple)):
        return tuple(map(_value, x))
    return x


def rows_of(rows) -> list:
    return sorted((tuple(map(_value, r)) for r in rows), key=repr)


def assert_same(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.select(*sorted(names)).collect()) == rows_of([tuple(r[names.index(c)] for c in sorted(names)) for r in got.fetchall()])
