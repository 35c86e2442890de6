"""Spark results against DuckDB on the same files."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def same(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{p}'")
    rel = con.sql(sql)
    names = sorted(rel.columns)
    assert names == sorted(df.columns)
    want = [tuple(normal(r[rel.columns.index(n)]) for n in names) for r in rel.fetchall()]
    got = [tuple(normal(v) for v in r) for r in df.select(*names).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
