"""The view layer in Spark SQL.

The reference keeps its feature engineering as a chain of database views.
``register_views`` creates the same chain as session temp views over the
mapped source tables, in dependency order, and ``final_view`` returns the
last one.  It yields the same rows as ``wide.customer_wide``.  The names carry
a prefix of their own for every call, so two roots or dates in one session
never read each other's views.  The pivots, the activity flag and the customer
fact are one aggregate over six months of orders, branch visits and the
segment fact one over the lines.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession

from segmint.functions.dates import month_end_of, month_start_of
from segmint.plans import domain as d

_calls = itertools.count()


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _in_list(values) -> str:
    return ", ".join(map(_text, values))


def view_statements(as_of=d.AS_OF, event_as_of=d.EVENT_AS_OF, prefix: str = "seg_") -> list[tuple[str, str]]:
    """``(view name, SELECT text)`` in dependency order."""
    p = prefix
    half, lo, last, hi = (month_start_of(as_of, m) for m in (d.FACT_MONTHS, d.MONTHS, 1, 0))
    snap = month_end_of(as_of, 1)
    w_lo, w_hi = month_end_of(as_of, d.MONTHS), month_end_of(as_of, 1)
    e_lo, e_hi = month_end_of(event_as_of, d.MONTHS), month_end_of(event_as_of, 1)
    classes = {**d.SPEND_CLASSES, **d.INCOME_CLASSES}
    pivots = ",\n  ".join(f"SUM(1L) FILTER (WHERE o_orderpriority = {_text(v)} AND o_orderdate >= DATE'{lo}') / 3D AS {a}_AVG_CNT, "
                          f"CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderpriority = {_text(v)} AND o_orderdate >= DATE'{lo}') AS DOUBLE) / 3D AS {a}_AVG_AMT"
                          for v, a in classes.items())
    fact = ",\n  ".join(f"{fn}({sql}) FILTER (WHERE o_orderdate >= DATE'{month_start_of(as_of, back)}') AS {name}" for name, (fn, sql, back) in d.CUSTOMER_FACT.items())
    here = ", ".join(f"CASE WHEN M_ACT_FLAG IS NOT NULL THEN CAST({c} AS DOUBLE) END AS {c}" for c in d.CUSTOMER_FACT)
    stems = ", ".join(f"{a}_AVG_CNT, {a}_AVG_AMT" for a in classes.values())
    visit = f"l_shipdate BETWEEN DATE'{w_lo}' AND DATE'{w_hi}' AND l_extendedprice > 0 AND l_returnflag != {_text(d.BRANCH_EXCLUDED_RETURNFLAG)}"
    month = f"l_shipdate >= DATE'{last}'"
    partial = ",\n         ".join(f"{fn}({sql}) FILTER (WHERE {month}) AS {name}" for name, (fn, sql) in d.SEGMENT_FACT.items())
    whole = {"sum": "SUM", "count": "SUM", "min": "MIN", "max": "MAX"}
    measures = ",\n  ".join(
        "CASE WHEN SUM(n_lines) > 0 THEN " + (f"{whole[fn]}({name})" if name in d.FLAG_MEASURES else f"CAST({whole[fn]}({name}) AS DOUBLE)") + f" END AS {name}"
        for name, (fn, _) in d.SEGMENT_FACT.items())
    channels = []
    for name, types in d.CHANNEL_EVENT_TYPES.items():
        cnt, amt = d.CHANNEL_NAMES[name]
        cond = f"event_type IN ({_in_list(types)})"
        channels.append(f"NULLIF(COUNT(*) FILTER (WHERE {cond}), 0) / 3D AS {cnt},\n"
                        f"  CAST(ROUND(SUM(CAST(value AS DECIMAL(18,2))) FILTER (WHERE {cond}) / 3, 1) AS DOUBLE) AS {amt}")
    all_types = [t for ts in d.CHANNEL_EVENT_TYPES.values() for t in ts]
    bcnt, bamt = d.CHANNEL_NAMES["BRNCH"]
    cnts = ", ".join(d.CHANNEL_NAMES[c][0] for c in d.CHANNEL_NAMES)
    amts = ", ".join(d.CHANNEL_NAMES[c][1] for c in d.CHANNEL_NAMES)
    return [
        (f"{p}base", f"""
SELECT c.c_custkey AS PERS_ID, c.c_name AS UNI_PT_KEY, r.r_name AS REGION, n.n_name AS PREF_CITY, c.c_mktsegment AS SOC_SEG,
       c.c_acctbal AS MONTHLY_INCOME
FROM {p}src_customer c
LEFT JOIN {p}src_nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN {p}src_region r ON n.n_regionkey = r.r_regionkey"""),
        (f"{p}order_sums", f"""
SELECT o_custkey AS PERS_ID,
  {pivots},
  MAX(CASE WHEN o_orderstatus = {_text(d.ACTIVE_STATUS)} THEN 1 ELSE 0 END) FILTER (WHERE o_orderdate >= DATE'{last}') AS M_ACT_FLAG,
  {fact}
FROM {p}src_orders
WHERE o_orderdate >= DATE'{half}' AND o_orderdate < DATE'{hi}'
GROUP BY o_custkey"""),
        (f"{p}orders", f"""
SELECT PERS_ID, {stems}, M_ACT_FLAG, {here}
FROM {p}order_sums"""),
        (f"{p}tenure", f"""
SELECT o_custkey AS PERS_ID,
       ({snap.year * 12 + snap.month} - (year(min(o_orderdate)) * 12 + month(min(o_orderdate)))) / 12D AS TENURE
FROM {p}src_orders WHERE o_orderdate < DATE'{hi}' GROUP BY o_custkey"""),
        (f"{p}events", f"""
SELECT user_id AS PERS_ID,
  {(','+chr(10)+'  ').join(channels)}
FROM {p}src_events
WHERE ts BETWEEN DATE'{e_lo}' AND DATE'{e_hi}' AND value > 0 AND event_type IN ({_in_list(all_types)})
GROUP BY user_id"""),
        (f"{p}lines", f"""
SELECT o.o_custkey AS PERS_ID, NULLIF(SUM(n_visits), 0) / 3D AS {bcnt},
  CAST(ROUND(SUM(visit_amt) / 3, 1) AS DOUBLE) AS {bamt},
  {measures}
FROM (SELECT l_orderkey, COUNT(*) FILTER (WHERE {visit}) AS n_visits,
         SUM(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE {visit}) AS visit_amt, COUNT(*) FILTER (WHERE {month}) AS n_lines,
         {partial}
      FROM {p}src_lineitem
      WHERE l_shipdate >= DATE'{w_lo}' AND l_shipdate < DATE'{hi}'
      GROUP BY l_orderkey) l
JOIN {p}src_orders o ON l.l_orderkey = o.o_orderkey
GROUP BY o.o_custkey"""),
        (f"{p}final", f"""
SELECT PERS_ID, {', '.join(d.REPORTING_VARIABLES)}, MONTHLY_INCOME, TENURE, {stems}, {cnts}, {amts},
  UNI_PT_KEY, {', '.join(d.CUSTOMER_FACT)}, {', '.join(d.SEGMENT_FACT)}
FROM {p}base
JOIN (SELECT * FROM {p}orders WHERE M_ACT_FLAG = 1) USING (PERS_ID)
LEFT JOIN {p}tenure USING (PERS_ID)
LEFT JOIN {p}events USING (PERS_ID)
LEFT JOIN {p}lines USING (PERS_ID)"""),
    ]


TABLES = ("orders", "customer", "nation", "region", "events", "lineitem")


def register_views(spark: SparkSession, root: str, as_of=d.AS_OF, event_as_of=d.EVENT_AS_OF, prefix: str | None = None) -> list[str]:
    """Register the source tables and every view; return the view names in order."""
    prefix = prefix or f"seg{next(_calls)}_"
    for t in TABLES:
        d.table(spark, root, t).createOrReplaceTempView(f"{prefix}src_{t}")
    names = []
    for name, sql in view_statements(as_of, event_as_of, prefix):
        spark.sql(f"CREATE OR REPLACE TEMP VIEW {name} AS {sql}")
        names.append(name)
    return names


def final_view(spark: SparkSession, root: str, as_of=d.AS_OF, event_as_of=d.EVENT_AS_OF) -> DataFrame:
    """The last view as a frame; the views' names, which only its text needed, are dropped again."""
    prefix = f"seg{next(_calls)}_"
    names = register_views(spark, root, as_of, event_as_of, prefix)
    found = spark.table(names[-1])
    for name in [*reversed(names), *[f"{prefix}src_{t}" for t in TABLES]]:  # what reads before what is read
        spark.catalog.dropTempView(name)
    return found
