"""Every query with SQL gives what DuckDB gives on the same tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from regionary.plans import catalogue, regions  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    cell = lambda v: None if pd.isna(v) else round(float(v), 9) if not isinstance(v, str | bool) else v
    return sorted((tuple(map(str, map(cell, r))) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    ours, theirs = catalogue.QUERIES[name](spark, SF).toPandas(), con.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"key", "members", "first_doc"}
