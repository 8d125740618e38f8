"""Plans: equi-joins only, pushed filters, no Python where none is needed, and the registered queries against DuckDB."""

import re

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from routeloom import storage
from routeloom.operators import flaps, rib
from routeloom.plans import ORACLES, QUERIES
from routeloom.plans import fixtures as fx

SF = "/root/testdata/sf0.001"
PYTHON = {"corpus_round_trip", "chunk_documents", "similarity_topk", "retrieval_scores", "chunk_search", "context_documents"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_its_oracle(spark, duck, name):
    assert compare(spark, duck, SF, name) == ""


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_shape(spark, name, monkeypatch):
    """Of the query and of every table that it stores on the way, without broadcasts that small data invites."""
    plans = []
    monkeypatch.setattr(storage, "WATCHERS", [lambda df: plans.append(plan_of(df))])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans.append(plan_of(QUERIES[name](spark, SF)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for plan in plans:
        assert "CartesianProduct" not in plan
        assert "BroadcastNestedLoopJoin" not in plan
        if name not in PYTHON:
            assert not re.search(r"Python|Pandas", plan)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(rib.update_slices(fx.load(spark, SF, "fx_updates")))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in plan.replace("event_type:string,ts:timestamp_ntz", "ts:timestamp_ntz,event_type:string")


def test_hot_prefix_is_windowed_in_buckets(spark):
    plan = plan_of(flaps.flap_summary(rib.announced_or_withdrawn(fx.load(spark, SF, "fx_updates"))))
    assert re.search(r"Exchange hashpartitioning\(prefix#\d+, _bucket#\d+L", plan)


def test_replay_combines_before_the_shuffle(spark):
    plan = plan_of(rib.replay(spark.createDataFrame([], "family int, net_hi bigint, net_lo bigint, plen int, prefix string, origin_as bigint, as_path array<bigint>"), fx.load(spark, SF, "fx_updates")))
    assert "partial_max_by" in plan
