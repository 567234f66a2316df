"""Named queries over the driver's tables, with SQL where SQL can express them."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name, sql=None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``; ``sql`` is its equivalent for DuckDB."""

    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return put


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
