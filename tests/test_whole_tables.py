"""Queries that no range of ids bounds: every row of a table takes part."""

from __future__ import annotations

import os

import pytest

from tessella.plans import queries as relational

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def test_log_holds_every_event_once(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "event_type").collect()
    got = {r.event_id: r.seq for r in relational.QUERIES["log_append_once"](spark, DATA).collect()}
    clicks = sorted(r.event_id for r in events if r.event_type == "click")
    rest = sorted(r.event_id for r in events if r.event_type != "click")
    assert clicks and rest and got == {e: i for i, e in enumerate(clicks + rest, 1)}


def test_write_set_is_not_a_range_of_ids(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet").selectExpr("event_type", "user_id", "ts > timestamp_ntz'2024-01-30' AS late").collect()
    want = {r.user_id for r in events if r.event_type == "signup"} & {r.user_id for r in events if r.late}
    got = [r.user_id for r in relational.QUERIES["write_conflicts"](spark, DATA).collect()]
    assert sorted(got) == sorted(want) and 0 < len(want) < len({r.user_id for r in events})


@pytest.mark.parametrize("kind", ["right", "full"])
def test_outer_joins_reach_all_ids(spark, kind):
    customers = {r.c_custkey for r in spark.read.parquet(f"{DATA}/customer.parquet").where("c_mktsegment = 'BUILDING'").collect()}
    orders = spark.read.parquet(f"{DATA}/orders.parquet").where("o_orderstatus <> 'F'").collect()
    want = [(r.o_custkey if r.o_custkey in customers else None, r.o_orderkey) for r in orders]
    if kind == "full":
        want += [(x, None) for x in customers - {r.o_custkey for r in orders}]
    got = [tuple(r) for r in relational.QUERIES[f"join_{kind}"](spark, DATA).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(a is None for a, _ in got) and any(a is not None and b is not None for a, b in got)
