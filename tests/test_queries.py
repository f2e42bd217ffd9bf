"""Every query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from sundew.queries import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, bool) or "bool" in str(type(v)):
        return str(bool(v))
    if v is None or v is pd.NA or v != v:
        return "None"
    return repr(float(v)) if hasattr(v, "dtype") or isinstance(v, (int, float)) else str(v)


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(v) for v in row) for row in df[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, tables, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(tables.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
