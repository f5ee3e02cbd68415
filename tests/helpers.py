"""Small graphs for tests, and comparison of rows."""

from __future__ import annotations

import datetime
import decimal
import os

from pyspark.sql import SparkSession

from quiver.engine import Engine
from quiver.graph import PropertyGraph

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def empty(spark: SparkSession, **kw) -> Engine:
    return Engine(PropertyGraph(spark), **kw)


def rows(engine: Engine, text: str, **params) -> list[tuple]:
    return [tuple(r) for r in engine.run(text, params).df.collect()]


def one(engine: Engine, expression: str, **params):
    """The value of an expression without a graph."""
    return rows(engine, f"RETURN {expression} AS x", **params)[0][0]


def normal(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if v != v else float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    if isinstance(v, dict):
        return tuple(normal(x) for x in v.values())
    return v


def ordered(columns: list[str], found: list) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [repr(tuple(normal(r[i]) for i in order)) for r in found]


def bag(columns: list[str], found: list) -> list[str]:
    return sorted(ordered(columns, found))


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con
