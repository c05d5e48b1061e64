"""Every query with a DuckDB statement gives the same rows, at the smallest scale."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from spanforge import registry

DATA = "/root/testdata/sf0.001"
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def _rows(frame):
    def value(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        return f"{float(v):.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(value, r)) for r in frame.astype(object)[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_statement(spark, duck, name):
    ours = registry.queries()[name](spark, DATA).toPandas()
    theirs = duck.execute(ORACLES[name]).fetch_df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _rows(ours) == _rows(theirs)


def test_statements_belong_to_queries():
    assert set(ORACLES) <= set(registry.queries())


def test_entry_stands_alone(spark):
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
