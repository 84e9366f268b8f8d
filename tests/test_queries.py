"""Each registered relational query against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from quern.plans.registry import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"create view {f[:-8]} as select * from read_parquet('{DIR}/{f}')")
    return c


def rows(df):
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return None
        if hasattr(v, "year"):
            return str(v)[:10]
        return v if isinstance(v, (bool, str)) else float(v)

    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_duckdb(spark, duck, name):
    assert rows(QUERIES[name](spark, DIR).toPandas()) == rows(duck.sql(ORACLE_SQL[name]).df())
