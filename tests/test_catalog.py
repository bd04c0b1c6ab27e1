"""Every catalogue query against its SQL, as DuckDB answers it."""

import glob
import os

import duckdb
import pytest

from quern.plans.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(repr(r[c]) for c in cols) for r in df.collect())
    if name not in SQL:
        assert got
        return
    want = duck.execute(SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(repr(r[i]) for i in at) for r in want.fetchall())
