"""Comparison of a query's rows with those of its SQL on DuckDB."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if hasattr(value, "tolist"):
        return tuple(map(plain, value.tolist()))
    return tuple(map(plain, value)) if isinstance(value, list) else value


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    found = con.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    got, want = rows(df.columns, df.collect()), rows(found.columns, found.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
