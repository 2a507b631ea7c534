"""Holds a query's rows against its SQL's."""

import math
import os

import duckdb


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "as_tuple"):
        return float(f"{float(v):.9g}")
    if isinstance(v, list | tuple):
        return tuple(map(norm, v))
    return v


def rows_of(columns, rows, order):
    at = [columns.index(c) for c in order]
    return sorted((tuple(norm(r[i]) for i in at) for r in rows), key=repr)


def assert_same(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    assert rows_of(df.columns, df.collect(), order) == rows_of(columns, result.fetchall(), order)
