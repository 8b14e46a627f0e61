"""Mapping of the test tables onto the segmentation domain.

The reference reads a bank warehouse (transactions by month-end snapshot,
customers, customer facts, two event facts).  The test data is a TPC-H-like
star schema plus an event table; this module is the one place that says which
table and column plays which role, and it returns frames in the domain's
column names so that every operator above it is table-agnostic.

| Domain                          | Test data                                         |
|---------------------------------|---------------------------------------------------|
| customer (PERS_ID)              | customer.c_custkey                                |
| PREF_CITY / REGION              | nation.n_name / region.r_name                     |
| SOC_SEG                         | customer.c_mktsegment                             |
| MONTHLY_INCOME                  | customer.c_acctbal                                |
| TENURE (years, whole months/12) | months from the first order to the snapshot month |
| transactions (snap, class, amt) | orders: last_day(o_orderdate), o_orderpriority,   |
|                                 | one count per order, o_totalprice                 |
| active in the last month        | an order in month -1 with o_orderstatus 'O'       |
| event fact (three channels)     | events: user_id, ts, event_type, value            |
| branch fact                     | lineitem joined to orders: o_custkey, l_shipdate, |
|                                 | l_extendedprice                                   |
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmint.functions.dates import month_end_of, month_start_of, months_index

# ---------------------------------------------------------------------------
# Fixed values of the mapping
# ---------------------------------------------------------------------------
AS_OF = dt.date(2001, 8, 15)          # transaction and branch snapshots
EVENT_AS_OF = dt.date(2024, 2, 15)    # event-channel snapshot
MONTHS = 3                            # window length and fixed denominator

# Transaction classes pivoted into spend columns and into income columns.
# Both lists read the same class column; a class in one list is "unlisted"
# for the other, as in the reference's two pivots.
SPEND_CLASSES = {"1-URGENT": "URGENT", "2-HIGH": "HIGH", "3-MEDIUM": "MEDIUM"}
INCOME_CLASSES = {"4-NOT SPECIFIED": "NOT_SPECIFIED", "5-LOW": "LOW"}

ACTIVE_STATUS = "O"                   # last-month activity flag
BRANCH_EXCLUDED_RETURNFLAG = "R"      # branch rows with this flag are not visits

# Event channels: output stem -> event types
CHANNEL_EVENT_TYPES = {
    "MB_IB": ["view", "click"],
    "POS": ["purchase"],
    "ATM": ["signup"],
}
CHANNEL_NAMES = {
    "MB_IB": ("AVG_MB_IB_TRN_CNT", "AVG_MB_IB_TRN_AMT"),
    "POS": ("AVG_POS_TRN_CNT", "AVG_POS_TRN_AMT"),
    "ATM": ("AVG_ATM_TRN_CNT", "AVG_ATM_TRN_AMT"),
    "BRNCH": ("AVG_BRNCH_VISIT_CNT", "AVG_BRNCH_TRN_AMT"),
}

# Measures of the two snapshot facts at the last month end.  The customer fact is keyed by the
# second key (the customer's name); it is an aggregate of orders: (function, SQL over one order,
# months back to the first and the last month).
SECOND_KEY = "UNI_PT_KEY"
_SPEND_IN = ", ".join(f"'{v}'" for v in SPEND_CLASSES)
_INCOME_IN = ", ".join(f"'{v}'" for v in INCOME_CLASSES)
CUSTOMER_FACT = {
    "T_ACCOUNTS_BAL": ("sum", "cast(o_totalprice AS decimal(18,2))", 1),
    "T_SAVINGS_BAL": ("max", "cast(o_totalprice AS decimal(18,2))", 1),
    "SIXMONTHS_TURNOVER": ("sum", "cast(o_totalprice AS decimal(18,2))", 6),
    "LOAN_AMOUNT": ("sum", f"CASE WHEN o_orderpriority IN ({_SPEND_IN}) THEN cast(o_totalprice AS decimal(18,2)) END", 1),
    "DEPO_AMOUNT": ("sum", f"CASE WHEN o_orderpriority IN ({_INCOME_IN}) THEN cast(o_totalprice AS decimal(18,2)) END", 1),
}
FACT_MONTHS = 6
# The segment fact: 28 measures of the lines shipped in the last month, (function, SQL over one line).
_PRICE, _QTY = "cast(l_extendedprice AS decimal(18,2))", "cast(l_quantity AS decimal(18,2))"


def _if(cond: str, value: str = "1") -> str:
    return f"CASE WHEN {cond} THEN {value} END"


SEGMENT_FACT = {
    "ACC_AVG_MIN_BAL": ("min", _PRICE), "ACC_AVG_MAX_BAL": ("max", _PRICE),
    "DEPO_AVG_MIN_BAL": ("min", _if("l_returnflag = 'N'", _PRICE)), "DEPO_AVG_MAX_BAL": ("max", _if("l_returnflag = 'N'", _PRICE)),
    "CARD_TRN_AMT_SUM_MIN_1": ("sum", _if("l_linenumber = 1", _PRICE)), "ACC_TRN_AMT_SUM_MIN_1": ("sum", _PRICE),
    "ACC_REST_START_MIN_1": ("min", _QTY), "ACC_REST_END_MIN_1": ("max", _QTY),
    "CARD_ATM_TRN_LAST_3": ("sum", _if("l_linenumber <= 3", _QTY)), "CARD_ATM_TRN_LAST_CNT_3": ("count", _if("l_linenumber <= 3")),
    "DB_CARD_FIRST_BAL_MIN_1": ("min", "l_tax"), "DB_CARD_LAST_BAL_MIN_1": ("max", "l_tax"),
    "LAST_LOAN_AMT": ("max", _if("l_returnflag = 'R'", _PRICE)), "LAST_LOAN_DPD": ("max", _if("l_returnflag = 'R'", "l_linenumber")),
    "ACT_TOT_LOAN_CNT": ("count", _if("l_linestatus = 'O'")), "ACT_TOT_LOAN_AMT": ("sum", _if("l_linestatus = 'O'", _PRICE)),
    "ACT_TOT_DPD": ("sum", _if("l_linestatus = 'O'", "l_linenumber")), "ACT_TOT_CNT_DPD": ("count", _if("l_linestatus = 'O' AND l_linenumber > 1")),
    "CLO_TOT_LOAN_CNT": ("count", _if("l_linestatus = 'F'")), "CLO_TOT_LOAN_AMT": ("sum", _if("l_linestatus = 'F'", _PRICE)),
    "CLO_TOT_DPD": ("sum", _if("l_linestatus = 'F'", "l_linenumber")), "CLO_TOT_CNT_DPD": ("count", _if("l_linestatus = 'F' AND l_linenumber > 1")),
    "IS_INT_BNK_USER": ("max", "CASE WHEN l_discount > 0.05 THEN '1' ELSE '0' END"), "IS_MOB_BNK_USER": ("max", "CASE WHEN l_tax > 0.04 THEN '1' ELSE '0' END"),
    "AVG_LOGIN_CNT_MOB_BNK": ("count", _if("l_tax > 0.04")), "AVG_LOGIN_CNT_INT_BNK": ("count", _if("l_discount > 0.05")),
    "AVG_TRN_CNT_INT_BNK": ("count", _if("l_quantity > 25")), "AVG_TRN_CNT_MOB_BNK": ("count", _if("l_quantity <= 25")),
}
FLAG_MEASURES = ("IS_INT_BNK_USER", "IS_MOB_BNK_USER")

KEY = "PERS_ID"
MODEL_VARIABLES = ["MONTHLY_INCOME", "TENURE"] + [
    f"{a}_AVG_{m}" for a in list(SPEND_CLASSES.values()) + list(INCOME_CLASSES.values())
    for m in ("CNT", "AMT")] + [c for c, _ in CHANNEL_NAMES.values()] + [a for _, a in CHANNEL_NAMES.values()]
REPORTING_VARIABLES = ["REGION", "PREF_CITY", "SOC_SEG"]


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(root, f"{name}.parquet"))


def window_bounds(as_of=AS_OF, months: int = MONTHS) -> tuple[dt.date, dt.date]:
    """``[first day of month -months, first day of the as_of month)``."""
    return month_start_of(as_of, months), month_start_of(as_of, 0)


# ---------------------------------------------------------------------------
# Source frames in domain names
# ---------------------------------------------------------------------------

def transactions(spark: SparkSession, root: str, as_of=AS_OF, months: int = MONTHS) -> DataFrame:
    """``(PERS_ID, SNAP_DATE, TRN_CLASS_DESCR, CNT, AMT)`` of the window's months.

    The date range on the raw ``o_orderdate`` is what reaches the Parquet
    scan as a pushed filter; ``SNAP_DATE`` is derived afterwards.  On a store
    partitioned by snapshot, ``sources.month_snapshots`` prunes instead.
    """
    lo, hi = window_bounds(as_of, months)
    o = table(spark, root, "orders")
    return (o.where((F.col("o_orderdate") >= F.lit(lo)) & (F.col("o_orderdate") < F.lit(hi)))
            .select(F.col("o_custkey").alias(KEY),
                    F.last_day(F.col("o_orderdate")).alias("SNAP_DATE"),
                    F.col("o_orderpriority").alias("TRN_CLASS_DESCR"),
                    F.lit(1).cast("long").alias("CNT"),
                    F.col("o_totalprice").cast("decimal(18,2)").alias("AMT")))


def active_keys(spark: SparkSession, root: str, as_of=AS_OF) -> DataFrame:
    """Customers active in month -1 (the reference's fact-table IN sub-query)."""
    lo, hi = month_start_of(as_of, 1), month_start_of(as_of, 0)
    o = table(spark, root, "orders")
    return (o.where((F.col("o_orderdate") >= F.lit(lo)) & (F.col("o_orderdate") < F.lit(hi))
                    & (F.col("o_orderstatus") == F.lit(ACTIVE_STATUS)))
            .select(F.col("o_custkey").alias(KEY)))


def customers(spark: SparkSession, root: str) -> DataFrame:
    """``(PERS_ID, PREF_CITY, SOC_SEG, MONTHLY_INCOME, NATION_KEY)``."""
    c = table(spark, root, "customer")
    n = table(spark, root, "nation").select("n_nationkey", "n_name")
    return (c.join(n, c.c_nationkey == n.n_nationkey, "left")
            .select(F.col("c_custkey").alias(KEY), F.col("n_name").alias("PREF_CITY"),
                    F.col("c_mktsegment").alias("SOC_SEG"),
                    F.col("c_acctbal").alias("MONTHLY_INCOME"),
                    F.col("c_nationkey").alias("NATION_KEY")))


def customer_profile(spark: SparkSession, root: str) -> DataFrame:
    """``(PERS_ID, REGION, PREF_CITY, SOC_SEG, MONTHLY_INCOME)`` from one customer scan.

    Nation and region are dimension tables; the planner broadcasts them on
    its own size check, so the customer rows are never shuffled for them.
    """
    c = table(spark, root, "customer")
    n = table(spark, root, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, root, "region").select("r_regionkey", "r_name")
    return (c.join(n, c.c_nationkey == n.n_nationkey, "left")
            .join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
            .select(F.col("c_custkey").alias(KEY), F.col("c_name").alias(SECOND_KEY), F.col("r_name").alias("REGION"),
                    F.col("n_name").alias("PREF_CITY"), F.col("c_mktsegment").alias("SOC_SEG"),
                    F.col("c_acctbal").alias("MONTHLY_INCOME")))


def tenure(spark: SparkSession, root: str, as_of=AS_OF) -> DataFrame:
    """``(PERS_ID, TENURE)``: whole months from the first order to the snapshot
    month, in years; one aggregate over the order history up to the snapshot."""
    snap = month_end_of(as_of, 1)
    o = table(spark, root, "orders")
    first = (o.where(F.col("o_orderdate") < F.lit(month_start_of(as_of, 0)))
             .groupBy(F.col("o_custkey").alias(KEY))
             .agg(F.min("o_orderdate").alias("__first")))
    return first.select(KEY, years_since("__first", snap).alias("TENURE"))


def years_since(first: str, snap: dt.date) -> Column:
    """Whole months from a day to the snapshot's month, in years."""
    return (F.lit(snap.year * 12 + snap.month) - months_index(first)) / F.lit(12.0)


def segment_attrs(spark: SparkSession, root: str, as_of=AS_OF) -> DataFrame:
    """``(PERS_ID, REGION, TENURE)``: the segment attributes block."""
    prof = customer_profile(spark, root).select(KEY, "REGION")
    return prof.join(tenure(spark, root, as_of), KEY, "left")


def order_block(spark: SparkSession, root: str, as_of=AS_OF, months: int = MONTHS) -> DataFrame:
    """``(PERS_ID, category averages..., M_ACT_FLAG, customer-fact measures...)`` from one scan of six months of orders.

    The spend and income pivots, the activity of the last month and the customer
    fact read the same orders, so they are one aggregate.  The fact has a row
    only for customers with an order in the last month.  Orders name the customer, and
    the second key belongs to one customer, so the block joins on ``PERS_ID`` like all others.
    """
    lo, last, w_lo, hi = (month_start_of(as_of, m) for m in (FACT_MONTHS, 1, months, 0))
    o = table(spark, root, "orders")
    o = o.where((F.col("o_orderdate") >= F.lit(lo)) & (F.col("o_orderdate") < F.lit(hi)))
    day, aggs = F.col("o_orderdate"), []
    for value, stem in {**SPEND_CLASSES, **INCOME_CLASSES}.items():
        own = (day >= F.lit(w_lo)) & (F.col("o_orderpriority") == F.lit(value))
        aggs += [F.sum(F.when(own, F.lit(1).cast("long"))).alias(f"{stem}_AVG_CNT"), F.sum(F.when(own, F.col("o_totalprice").cast("decimal(18,2)"))).alias(f"{stem}_AVG_AMT")]
    aggs += [F.max(F.when(day >= F.lit(last), (F.col("o_orderstatus") == F.lit(ACTIVE_STATUS)).cast("int"))).alias("M_ACT_FLAG")]
    for name, (fn, sql, back) in CUSTOMER_FACT.items():
        aggs.append(getattr(F, fn)(F.when(day >= F.lit(month_start_of(as_of, back)), F.expr(sql))).alias(name))
    per = o.groupBy(F.col("o_custkey").alias(KEY)).agg(*aggs)
    stems = [f"{s}_AVG_{m}" for s in {**SPEND_CLASSES, **INCOME_CLASSES}.values() for m in ("CNT", "AMT")]
    here = F.col("M_ACT_FLAG").isNotNull()
    return per.select(
        KEY, *[(F.col(c).cast("double") / F.lit(float(months))).alias(c) for c in stems], "M_ACT_FLAG",
        *[F.when(here, F.col(c).cast("double")).alias(c) for c in CUSTOMER_FACT])


def line_block(spark: SparkSession, root: str, as_of=AS_OF, months: int = MONTHS) -> DataFrame:
    """``(PERS_ID, N, AMT, segment-fact measures...)`` per order: branch rows and the 28 measures from one scan of lines.

    Lines are aggregated per order before the join to orders, see ``branch_fact``.
    """
    w_lo, w_hi, last, hi = month_end_of(as_of, months), month_end_of(as_of, 1), month_start_of(as_of, 1), month_start_of(as_of, 0)
    day = F.col("l_shipdate")
    visit = day.between(F.lit(w_lo), F.lit(w_hi)) & (F.col("l_extendedprice") > 0) & (F.col("l_returnflag") != F.lit(BRANCH_EXCLUDED_RETURNFLAG))
    month = (day >= F.lit(last)) & (day < F.lit(hi))
    lines = table(spark, root, "lineitem").where((day >= F.lit(w_lo)) & (day < F.lit(hi)))
    aggs = [F.count(F.when(visit, 1)).alias("N"), F.sum(F.when(visit, F.col("l_extendedprice").cast("decimal(18,2)"))).alias("AMT"), F.count(F.when(month, 1)).alias("__lines")]
    aggs += [getattr(F, fn)(F.when(month, F.expr(sql))).alias(name) for name, (fn, sql) in SEGMENT_FACT.items()]
    per_order = lines.groupBy("l_orderkey").agg(*aggs)
    o = table(spark, root, "orders").select("o_orderkey", "o_custkey")
    return per_order.join(o, per_order.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias(KEY), "N", "AMT", "__lines", *SEGMENT_FACT)


def event_fact(spark: SparkSession, root: str) -> DataFrame:
    """``(PERS_ID, TRN_DATE, EVENT_TYPE, AMT)`` from the events table."""
    e = table(spark, root, "events")
    return e.select(F.col("user_id").alias(KEY), F.col("ts").alias("TRN_DATE"),
                    F.col("event_type").alias("EVENT_TYPE"), F.col("value").alias("AMT"))


def event_window(as_of=EVENT_AS_OF, months: int = MONTHS) -> Column:
    """``TRN_DATE BETWEEN month_end(-months) AND month_end(-1)`` at midnight."""
    return F.col("TRN_DATE").between(F.lit(month_end_of(as_of, months)), F.lit(month_end_of(as_of, 1)))


def channel_predicates() -> dict[str, Column]:
    return {name: F.col("EVENT_TYPE").isin(types) for name, types in CHANNEL_EVENT_TYPES.items()}


def branch_fact(spark: SparkSession, root: str, as_of=AS_OF, months: int = MONTHS,
                lineitem: DataFrame | None = None, orders: DataFrame | None = None) -> DataFrame:
    """Per-order branch rows in the window: ``(PERS_ID, N, AMT)``.

    Lines are filtered and pre-aggregated per order *before* the join to
    orders, so the join sees one row per order; the aggregate's hash
    partitioning on the order key is reused by the join.  ``lineitem`` and
    ``orders`` may be given as tables bucketed by order key, which removes
    the shuffle of both sides.
    """
    li = lineitem if lineitem is not None else table(spark, root, "lineitem")
    o = (orders if orders is not None else table(spark, root, "orders")).select("o_orderkey", "o_custkey")
    lo, hi = month_end_of(as_of, months), month_end_of(as_of, 1)
    lines = li.where(F.col("l_shipdate").between(F.lit(lo), F.lit(hi))
                     & (F.col("l_extendedprice") > 0)
                     & (F.col("l_returnflag") != F.lit(BRANCH_EXCLUDED_RETURNFLAG)))
    per_order = lines.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("N"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("AMT"))
    return (per_order.join(o, per_order.l_orderkey == o.o_orderkey)
            .select(F.col("o_custkey").alias(KEY), "N", "AMT"))
