"""The sub-package's queries on the smallest tables: equal to their SQL where there is one, with rows otherwise."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from lorekiln.llm import queries as Q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def cells(df, columns):
    show = lambda x: "" if pd.api.types.is_scalar(x) and pd.isna(x) else f"{x:.5f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(show(x) for x in r) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    got, want = Q.queries()[name](spark, DATA).toPandas(), con.execute(Q.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and cells(got, columns) == cells(want, columns)


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.SQL)))
def test_query_runs(spark, name):
    assert Q.queries()[name](spark, DATA).count() > 0


def test_round_trip(spark):
    assert Q.p8_roundtrip(spark, DATA).where("not same").count() == 0


def test_containers_are_well_filled(spark):
    rows = Q.p9_containers(spark, DATA).collect()
    assert max(r.tokens for r in rows) <= 2048 and sum(r.tokens for r in rows) > 2048 * (len(rows) - 1) * 0.97
