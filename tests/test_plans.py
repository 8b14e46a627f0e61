"""Plan guards: the shapes that do not survive 100x more data must not appear."""

import os

import pytest

from conftest import SF0001
from segmint.plans.queries import QUERIES

pytestmark = pytest.mark.skipif(not os.path.exists(SF0001), reason="test data missing")

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_forbidden_operators(spark, name):
    plan = _plan(QUERIES[name](spark, SF0001))
    for op in FORBIDDEN:
        assert op not in plan, f"{name}: {op}"


def test_window_filters_reach_the_scan(spark):
    from segmint.plans import wide
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    plan = _plan(wide.customer_wide(spark, SF0001))
    assert "GreaterThanOrEqual(o_orderdate,2001-02-01" in plan        # six months: pivots, activity and customer fact
    assert "GreaterThanOrEqual(l_shipdate,2001-05-31" in plan and "LessThan(l_shipdate,2001-08-01" in plan
    assert "GreaterThanOrEqual(ts,2023-11-30" in plan


def test_pivots_share_one_aggregate(spark):
    from segmint.plans import wide
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    plan = wide.customer_wide(spark, SF0001)._jdf.queryExecution().optimizedPlan().toString()
    aggs = [ln for ln in plan.splitlines() if "Aggregate" in ln and "URGENT_AVG_CNT" in ln]
    # spend (URGENT) and income (LOW) pivots come out of the same aggregate
    assert len(aggs) == 1 and "LOW_AVG_CNT" in aggs[0], aggs


def test_projection_is_pruned(spark):
    from segmint.plans import queries as q
    plan = _plan(q.q_channel_branch(spark, SF0001))
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_returnflag:string,l_shipdate" in plan \
        or "l_quantity" not in plan


@pytest.mark.parametrize("form", ["dataframe", "sql"])
def test_wide_row_shuffles_each_input_once_at_scale(spark, form):
    """Blocks too large to broadcast: one exchange per aggregate and key; activity comes with the order block."""
    from conftest import SF001
    from segmint.plans import views, wide
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = wide.customer_wide(spark, SF001) if form == "dataframe" else views.final_view(spark, SF001)
        plan = _plan(df)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning") == 7, plan
    assert plan.count("BroadcastExchange") == 2          # nation and region only
    assert plan.count("orders.parquet") == 3             # six months, tenure, keys of the lines' orders
    assert plan.count("lineitem.parquet") == 1


def test_month_snapshots_prune_partition_folders(spark, tmp_dir):
    """On a store partitioned by snapshot, the three months are partition filters, not a row filter."""
    import datetime as dt
    from pyspark.sql import functions as F
    from segmint.sources import snapshots
    from segmint.plans import domain as d
    orders = d.table(spark, SF0001, "orders")
    trn = orders.select(F.col("o_custkey").alias("PERS_ID"), F.col("o_totalprice").alias("AMT"),
                        F.last_day("o_orderdate").alias("snap_date"))
    root = f"{tmp_dir}/trn_store"
    snapshots.write_snapshot(trn.where(F.col("snap_date") >= F.lit(dt.date(2001, 1, 1))), root)
    got = snapshots.month_snapshots(spark.read.parquet(root), d.AS_OF)
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    plan = _plan(got)
    import re
    assert re.search(r"PartitionFilters: \[[^\]]*snap_date[^\]]*2001-07-31", plan), plan
    assert "DataFilters: []" in plan
    assert {r.snap_date for r in got.select("snap_date").distinct().collect()} <= \
        {dt.date(2001, 5, 31), dt.date(2001, 6, 30), dt.date(2001, 7, 31)}
    want = trn.where(F.col("snap_date").isin(dt.date(2001, 5, 31), dt.date(2001, 6, 30), dt.date(2001, 7, 31)))
    assert got.count() == want.count()


def test_bucketed_facts_join_without_shuffle(spark):
    """lineitem and orders bucketed by order key: the branch join shuffles neither side."""
    from segmint.plans import domain as d
    from segmint.sources.sinks import write_bucketed
    write_bucketed(d.table(spark, SF0001, "lineitem"), "li_by_order", "l_orderkey", 8)
    write_bucketed(d.table(spark, SF0001, "orders"), "orders_by_order", "o_orderkey", 8)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        fact = d.branch_fact(spark, SF0001, lineitem=spark.table("li_by_order"),
                             orders=spark.table("orders_by_order"))
        plan = _plan(fact)
        plain = _plan(d.branch_fact(spark, SF0001))
        rows = sorted(map(tuple, fact.collect()))
        want = sorted(map(tuple, d.branch_fact(spark, SF0001).collect()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
    assert plain.count("Exchange hashpartitioning") == 2
    assert rows == want
