"""Runs a query on Spark and its SQL on DuckDB and compares the two, in any order of rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.10g}")
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    if hasattr(x, "asDict"):
        return tuple((k, plain(v)) for k, v in x.asDict().items())
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


def rows(names: list[str], found) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def difference(spark, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same rows and names."""
    ours = query(spark, sf_dir)
    rel = database(sf_dir).sql(sql)
    names = list(rel.columns)
    if sorted(names) != sorted(ours.columns):
        return f"columns {sorted(ours.columns)} and {sorted(names)}"
    a, b = rows(ours.columns, ours.collect()), rows(names, rel.fetchall())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    for x, y in zip(a, b):
        if x != y:
            return f"{x} and {y}"
    return ""
