"""Spark results against DuckDB results, order-blind."""

import os
from functools import cache

import duckdb
import pandas as pd

ROOT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@cache
def connection(root: str = ROOT):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{root}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def _cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if hasattr(v, "year"):
        return str(v)[:19].removesuffix(" 00:00:00")
    if isinstance(v, float):
        return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)
    return str(v)


def normal(df: pd.DataFrame) -> list[tuple]:
    names = sorted(df.columns)
    rows = list(zip(*[[_cell(v) for v in df[n].astype(object)] for n in names], strict=True)) if names else []
    return [tuple(names), *sorted(rows, key=lambda r: tuple((x is not None, x or "") for x in r))]


def assert_same(got, sql: str, root: str = ROOT) -> None:
    want = connection(root).sql(sql).df()
    a, b = normal(got.toPandas()), normal(want)
    assert a[0] == b[0]
    assert len(a) == len(b)
    assert a == b, [(x, y) for x, y in zip(a, b, strict=True) if x != y][:3]
