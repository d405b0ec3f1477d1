"""Every query that has SQL gives what DuckDB gives on the smallest tables; the others run and have rows."""

import datetime as dt
import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from lorekiln.plans import catalog_queries, change_queries, page_queries, parity_queries, search_queries

DATA = "/root/testdata/sf0.001"
MODULES = (change_queries, catalog_queries, search_queries, page_queries, parity_queries)
QUERIES = {n: f for m in MODULES for n, f in m.QUERIES.items()}
SQL = {n: s for m in MODULES for n, s in m.SQL.items()}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def cell(x):
    if pd.api.types.is_scalar(x) and pd.isna(x):
        return ""
    if isinstance(x, (pd.Timestamp, dt.datetime)):
        return str(pd.Timestamp(x))
    if isinstance(x, bool):
        return str(x)
    return f"{x:.5f}" if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "if" else str(x)


def table_of(df, columns):
    return sorted(tuple(cell(x) for x in r) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert table_of(got, columns) == table_of(want, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_python_in_native_plans(spark):
    for name in ("bm25_search", "manifest_delta", "catalog_upsert", "dense_topk", "p6_found", "md_clean"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan, name
