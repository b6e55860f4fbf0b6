"""Every relational query against DuckDB over the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from tessella.plans import queries as relational

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", list(relational.QUERIES))
def test_same_as_sql(spark, db, name):
    df = relational.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = db.sql(relational.ORACLE_SQL[name])
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(tuple(r[i] for i in at) for r in want.fetchall())


def test_filters_reach_the_scan(spark):
    from tessella.operators.scans import explain

    plan = explain(relational.QUERIES["q6_revenue"](spark, DATA))
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_shipdate:timestamp_ntz>" in plan
