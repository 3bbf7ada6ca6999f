"""Side-by-side comparison of a query with its SQL in DuckDB."""

from __future__ import annotations

import datetime
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    if isinstance(v, float) and v != v:
        return None
    return str(v)[:19] if isinstance(v, (datetime.datetime, datetime.date)) else v


def rows(names: list[str], values) -> list[list]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in values), key=lambda r: [(x is None, str(x)) for x in r])


def assert_same(df, con, sql: str) -> None:
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    ours, theirs = rows(df.columns, df.collect()), rows(rel.columns, rel.fetchall())
    assert len(ours) == len(theirs)
    differing = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    assert not differing, differing[:3]
