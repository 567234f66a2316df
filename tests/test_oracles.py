"""Every query with an oracle against DuckDB on the smallest tables."""

import glob
import os

import pytest

from logoscope.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def shown(rows, columns):
    return sorted(repr([r[c] for c in sorted(columns)]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    got = [r.asDict() for r in df.collect()]
    assert name in catalog.ORACLES
    want = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert shown(got, columns) == shown([dict(zip(columns, r, strict=True)) for r in want.fetchall()], columns)
