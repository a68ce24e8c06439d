"""Every query with SQL against DuckDB on the smallest tables; the others must give rows with a stable schema."""

import os

import duckdb
import pandas as pd
import pytest

from folioscope.plans import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SMALL}/{f}'")
    return con


def rows(frame, columns):
    def show(v):
        if v is None or (not isinstance(v, str) and pd.isna(v)):
            return "NULL"
        if isinstance(v, str):
            return v
        return repr(round(float(v), 9))

    return sorted(tuple(show(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = con.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 40
