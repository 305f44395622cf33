"""Runs a query and its SQL on the same tables and compares them, whatever the order of rows and columns."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x: object) -> object:
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.12g}")
    return x.isoformat() if isinstance(x, datetime.datetime) else x


def rows(names: list[str], data: list[tuple]) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def compare(df, sql: str, con: duckdb.DuckDBPyConnection) -> tuple[int, int]:
    """(rows only in df, rows only in the SQL's result); raises if the columns' names differ."""
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns), (names, df.columns)
    ours, theirs = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, got.fetchall())
    return (ours - theirs).total(), (theirs - ours).total()
