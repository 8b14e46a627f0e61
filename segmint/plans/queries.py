"""Registered queries: one per operator family of SURVEY section 2.

Each callable takes ``(spark, root)`` and returns a DataFrame over the whole
test tables at ``root``.  Floating outputs that two engines sum in different
orders are presented at a fixed precision (NumPy-style rounding) so results
can be compared cell by cell; of the library functions only the profile, the
shares and the correlation (by default) round, as the reference shows them.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmint.functions.dates import month_end, month_end_of, snapshot_label
from segmint.functions.prep import (cap_value, dedup_first, fill_selected, flag_to_int, impute_defaults,
                                   parse_all_valid, select_variables, strip_timezone)
from segmint.operators import features as feat
from segmint.operators import filters as flt
from segmint.operators import model as mdl
from segmint.operators import stats as st
from segmint.plans import domain as d
from segmint.plans import views, wide
from segmint.session import checkpoint_dir
from segmint.sources import catalog, readers, sinks
from segmint.sources.store import MonthStore
from segmint.sources.snapshots import month_snapshots, snapshot_or_build, union_months, write_snapshot

# ---------------------------------------------------------------------------
# Query parameters (fixed)
# ---------------------------------------------------------------------------
SEG_MODEL = ["MONTHLY_INCOME", "AVG_MB_IB_TRN_AMT", "URGENT_AVG_AMT"]
SEG_REPORT = ["REGION", "SOC_SEG"]
CORR_VARS = ["MONTHLY_INCOME", "TENURE", "URGENT_AVG_CNT", "URGENT_AVG_AMT", "LOW_AVG_AMT",
             "AVG_MB_IB_TRN_CNT", "AVG_MB_IB_TRN_AMT", "AVG_POS_TRN_CNT", "AVG_POS_TRN_AMT",
             "AVG_BRNCH_VISIT_CNT", "AVG_BRNCH_TRN_AMT"]
PRICE_VARS = ["l_quantity", "l_extendedprice", "disc_price", "charge"]
LI_DESCRIBE = ["l_quantity", "l_extendedprice", "l_discount"]
LI_MODEL = ["l_quantity", "l_discount", "l_tax"]
LI_K = 7                      # clusters given by l_linenumber - 1
ELBOW_K_MAX = 10              # elbow sweep k = 3..10
FINAL_K = 17                  # the golden run's k
PREC = 6                      # presentation precision of summed/averaged floats
IMPUTE_TEXT = {"PREF_CITY": "Undefined", "REGION": "Undefined", "SOC_SEG": "Undefined"}
IMPUTE_NUM = {"AVG_MB_IB_TRN_CNT": 0, "AVG_POS_TRN_CNT": 0, "AVG_ATM_TRN_CNT": 0, "MONTHLY_INCOME": 0}
RANGES = {"MONTHLY_INCOME": (0.0, 5000.0), "TENURE": (0.0, 0.0),
          "AVG_MB_IB_TRN_CNT": (2.0, 10.0)}
MEMBERS = {"SOC_SEG": ["BUILDING", "MACHINERY", "HOUSEHOLD"], "PREF_CITY": [],
           "REGION": ["ASIA", "EUROPE", "AMERICA"]}
STRICT_RANGES = {"MONTHLY_INCOME": (-1000.0, 8000.0), "TENURE": (0.0, 30.0),
                 "AVG_POS_TRN_CNT": (0.0, 100.0), "AVG_ATM_TRN_CNT": (0.0, 50.0)}
STRICT_MEMBERS = {"SOC_SEG": ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"],
                  "REGION": ["AFRICA", "AMERICA", "ASIA", "EUROPE"]}
SEGMENT_FORM = {
    "ranges": {"MONTHLY_INCOME": (500.0, 9000.0), "TENURE": (0.0, 0.0),
               "AVG_MB_IB_TRN_CNT": (0.0, 0.0), "AVG_POS_TRN_CNT": (1.0, 6.0),
               "AVG_ATM_TRN_CNT": (0.0, 0.0)},
    "members": {"SOC_SEG": ["BUILDING", "FURNITURE", "AUTOMOBILE"], "REGION": [],
                "PREF_CITY": []},
}
AUTO_CRITERIA = {"MONTHLY_INCOME": None, "SOC_SEG": ["BUILDING", "MACHINERY"],
                 "PREF_CITY": ["NATION_1", "NATION_2", "NATION_3", "NATION_5", "NATION_8",
                               "NATION_13", "NATION_21"]}
# The form of the cascade: choices in order, the last controls untouched.
CASCADE = {"SOC_SEG": ["BUILDING", "MACHINERY", "FURNITURE"], "MONTHLY_INCOME": (500.0, 9000.0), "REGION": ["ASIA", "EUROPE", "AFRICA"],
           "AVG_ATM_TRN_CNT": None, "PREF_CITY": None, "AVG_POS_TRN_CNT": None}
STORE_EVENT_DATES = (d.EVENT_AS_OF, dt.date(2024, 1, 15))
DATE_RANGE = ("1996-01-01", "1996-03-31")
REGEX = "^Customer#0+1[0-9]*7$"


def _round_cols(df: DataFrame, cols, digits: int = PREC) -> DataFrame:
    cols = set(cols)
    return df.select(*[st.np_round(F.col(c), digits).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def _lineitem_labelled(spark: SparkSession, root: str) -> DataFrame:
    li = d.table(spark, root, "lineitem")
    return li.select("l_orderkey", "l_linenumber", *sorted(set(LI_DESCRIBE + LI_MODEL)),
                     (F.col("l_linenumber") - 1).cast("int").alias("Cluster"))


def _seg(spark, root):
    return wide.segment_input(spark, root)


# ---------------------------------------------------------------------------
# Sources, projections, views
# ---------------------------------------------------------------------------

def q_scan_customer(spark, root):
    return d.customers(spark, root)


def q_scan_ranges(spark, root):
    """The ranges that a parallel database scan of orders would use; every row is in one."""
    o = d.table(spark, root, "orders")
    ranges = readers.key_ranges(o.select("o_custkey", "o_orderkey"), "o_custkey", 16, hot_by="o_orderkey")
    hits = " + ".join(f"CASE WHEN {p} THEN 1 ELSE 0 END" for p in ranges)
    return o.select("o_orderkey", F.expr(hits).alias("n_ranges"))


def q_customer_wide(spark, root):
    return wide.customer_wide(spark, root)


def q_view_layer_sql(spark, root):
    return views.final_view(spark, root)


def _present_trn(trn: DataFrame) -> DataFrame:
    return (trn.withColumn("AMT", F.col("AMT").cast("double"))
            .withColumn("SNAP_DATE", F.date_format("SNAP_DATE", "yyyy-MM-dd")))


def q_month_snapshot(spark, root):
    return _present_trn(month_snapshots(d.transactions(spark, root), d.AS_OF, months=(1,), snap_col="SNAP_DATE"))


def q_union_months(spark, root):
    return _present_trn(union_months(d.transactions(spark, root), d.AS_OF, months=(1, 2, 3), snap_col="SNAP_DATE"))


def q_segment_attrs(spark, root):
    return d.segment_attrs(spark, root)


def q_spend_avg(spark, root):
    base = d.customers(spark, root).select(d.KEY)
    return feat.attach(base, d.KEY, [wide.spend_income_block(spark, root, classes=d.SPEND_CLASSES)])


def q_income_avg(spark, root):
    base = d.customers(spark, root).select(d.KEY)
    return feat.attach(base, d.KEY, [wide.spend_income_block(spark, root, classes=d.INCOME_CLASSES)])


def q_spend_pivot(spark, root):
    return wide.spend_income_block(spark, root, classes=d.SPEND_CLASSES, sums=True)


def q_income_pivot(spark, root):
    return wide.spend_income_block(spark, root, classes=d.INCOME_CLASSES, sums=True)


def q_select_model_vars(spark, root):
    seg = select_variables(_seg(spark, root), d.KEY, SEG_MODEL, SEG_REPORT)
    return fill_selected(seg, SEG_MODEL + SEG_REPORT, 0, "0")


def q_feature_vectors(spark, root):
    seg = fill_selected(_seg(spark, root).select(d.KEY, *SEG_MODEL), SEG_MODEL, 0, None)
    return mdl.assemble(seg, SEG_MODEL).select(d.KEY, vector_to_array("features").alias("features"))


def q_left_join_features(spark, root):
    base = d.customers(spark, root).select(d.KEY, "SOC_SEG")
    return feat.attach(base, d.KEY, [d.segment_attrs(spark, root),
                                     wide.spend_income_block(spark, root, classes=d.SPEND_CLASSES)])


def q_active_customers(spark, root):
    return feat.semi_join(d.customers(spark, root), d.active_keys(spark, root), d.KEY)


# ---------------------------------------------------------------------------
# Sources and sinks: what is written and read again
# ---------------------------------------------------------------------------

def _scratch(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/segmint-{uuid.uuid4().hex}"


def q_client_csv_roundtrip(spark, root):
    """S10 then S3: the client table as CSV files, read with an explicit schema."""
    path = _scratch(spark)
    c = d.table(spark, root, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    sinks.write_client_table(c, path)
    return readers.read_csv(spark, path, "c_custkey long, c_name string, c_mktsegment string, c_acctbal double")


def q_wide_csv_roundtrip(spark, root):
    """The application's file input: names from the header line, numeric columns converted and checked."""
    path = _scratch(spark)
    c = d.customers(spark, root).select(d.KEY, F.col("SOC_SEG").alias('SEG, "main"'), "MONTHLY_INCOME")
    sinks.write_client_table(c, path)
    back = readers.read_wide_csv(spark, path, [d.KEY, "MONTHLY_INCOME"])
    return back.select(F.col(d.KEY).cast("long").alias(d.KEY), F.col('`SEG, "main"`').alias("SOC_SEG"), "MONTHLY_INCOME")


def q_profile_csv_roundtrip(spark, root):
    """The profile file, read again."""
    path = _scratch(spark)
    sinks.write_profile(q_profile_wide(spark, root), path)
    return readers.read_csv(spark, path, "row_order int, row_label string, " + ", ".join(f"`{i}` double" for i in range(LI_K)))


def q_snapshot_roundtrip(spark, root):
    """Three months written, one replaced, month -1 read through (never built again)."""
    store = _scratch(spark)
    trn = d.transactions(spark, root).withColumn("SNAP_DATE", F.col("SNAP_DATE").cast("date"))
    write_snapshot(trn.withColumn("AMT", F.lit(0).cast("decimal(18,2)")), store, "SNAP_DATE")
    write_snapshot(month_snapshots(trn, d.AS_OF, months=(1,), snap_col="SNAP_DATE"), store, "SNAP_DATE")

    def never(snap):
        raise AssertionError(f"{snap} is there already")

    got = snapshot_or_build(spark, store, d.AS_OF, never, "SNAP_DATE")
    return _present_trn(got.select(d.KEY, "SNAP_DATE", "TRN_CLASS_DESCR", "CNT", "AMT"))


def q_snapshot_store(spark, root):
    """S6 with all parameters: the channels of two event dates in one month's store, read back after both are there."""
    store, month = MonthStore(spark, _scratch(spark)), month_end_of(d.AS_OF, 1)
    params = [{"source": root, "events": str(month_end_of(at, 1))} for at in STORE_EVENT_DATES]
    for own, at in zip(params, STORE_EVENT_DATES):
        store.read_or_build(month, own, lambda at=at: wide.event_channel_block(spark, root, at))
    parts = [store.read(month, own).withColumn("EVENT_MONTH", F.lit(own["events"])) for own in params]
    return parts[0].unionByName(parts[1])


def q_catalog_coverage(spark, root):
    """Every catalogued variable that the wide row has, with its role and how many customers have a value."""
    seg = _seg(spark, root)
    cat = catalog.load_catalog(spark)
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("v")) for c in seg.columns])
    counts = seg.select(F.inline(cells)).groupBy("variable").agg(F.count("v").alias("n_values"))
    return cat.join(counts, "variable").select("variable", "role", "n_values")


# ---------------------------------------------------------------------------
# Simple predicates
# ---------------------------------------------------------------------------

def q_predicate_in_dimension(spark, root):
    """F5 with a long list: the members are rows of a dimension table (semi join)."""
    li = d.table(spark, root, "lineitem")
    parts = d.table(spark, root, "part").where(F.col("p_type").startswith("S") & (F.col("p_size") > 10))
    return feat.semi_join(li, parts, "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


def q_predicate_ne(spark, root):
    li = d.table(spark, root, "lineitem")
    return li.where(F.col("l_returnflag") != "R").select("l_orderkey", "l_linenumber", "l_returnflag")


def q_predicate_gt(spark, root):
    ev = d.table(spark, root, "events")
    return ev.where(F.col("value") > 100).select("event_id", "user_id", "value")


def q_predicate_prefix(spark, root):
    p = d.table(spark, root, "part")
    return p.where(F.col("p_type").startswith("S")).select("p_partkey", "p_type")


def q_predicate_in(spark, root):
    ev = d.table(spark, root, "events")
    return ev.where(F.col("event_type").isin("view", "click")).select("event_id", "user_id", "event_type")


def q_predicate_not_in(spark, root):
    li = d.table(spark, root, "lineitem")
    return (li.where(~F.col("l_returnflag").isin("R", "A"))
            .select("l_orderkey", "l_linenumber", "l_returnflag"))


def q_window_filter(spark, root):
    li = d.table(spark, root, "lineitem")
    lo, hi = month_end_of(d.AS_OF, 3), month_end_of(d.AS_OF, 1)
    return (li.where(F.col("l_shipdate").between(F.lit(lo), F.lit(hi)))
            .select("l_orderkey", "l_linenumber", "l_shipdate"))


# ---------------------------------------------------------------------------
# Segment filters
# ---------------------------------------------------------------------------

def _filter_view(df):
    return df.select(d.KEY, "SOC_SEG", "REGION", "PREF_CITY", "MONTHLY_INCOME", "TENURE",
                     "AVG_MB_IB_TRN_CNT", "AVG_POS_TRN_CNT", "AVG_ATM_TRN_CNT")


def q_filter_optional_range(spark, root):
    return _filter_view(flt.apply_filters(_seg(spark, root), flt.from_form(ranges=RANGES)))


def q_filter_optional_member(spark, root):
    return _filter_view(flt.apply_filters(_seg(spark, root), flt.from_form(members=MEMBERS)))


def q_filter_strict(spark, root):
    seg = _seg(spark, root).withColumn("TENURE", cap_value("TENURE", 30.0))
    return _filter_view(flt.filter_segment(seg, STRICT_RANGES, STRICT_MEMBERS, mandatory=True))


def q_filter_segment(spark, root):
    seg = _seg(spark, root)
    return _filter_view(flt.filter_segment(seg, SEGMENT_FORM["ranges"], SEGMENT_FORM["members"]))


def q_filter_auto(spark, root):
    return _filter_view(flt.filter_auto(_seg(spark, root), AUTO_CRITERIA))


def q_filter_date_range(spark, root):
    o = d.table(spark, root, "orders")
    out = flt.apply_filters(o, [flt.DateRangeFilter("o_orderdate", DATE_RANGE)])
    return out.select("o_orderkey", "o_custkey", "o_orderdate")


def q_filter_auto_dates(spark, root):
    """F16, untouched: from the first to the last date, both at midnight."""
    e = d.table(spark, root, "events").select("event_id", "ts")
    return flt.filter_auto(e, {"ts": None})


def _city_frame(spark, root):
    """Customers whose city is known only for the first three regions (a left join that leaves nulls)."""
    c = d.table(spark, root, "customer").select(F.col("c_custkey").alias(d.KEY), "c_nationkey", "c_acctbal")
    n = d.table(spark, root, "nation").where(F.col("n_regionkey") < 3).select("n_nationkey", F.col("n_name").alias("PREF_CITY"))
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select(d.KEY, "PREF_CITY", F.col("c_acctbal").alias("MONTHLY_INCOME"))


def q_filter_null_choice(spark, root):
    """null is one of the values that can be chosen."""
    return flt.apply_filters(_city_frame(spark, root), [flt.MemberFilter("PREF_CITY", ["NATION_1", "NATION_2", None])])


def q_filter_panel(spark, root):
    """F13 with its first steps: cities filled, allowed columns, ATM counts always a range."""
    seg = _city_frame(spark, root).join(_seg(spark, root).select(d.KEY, "AVG_ATM_TRN_CNT"), d.KEY)
    return flt.filter_panel(seg, {"PREF_CITY": ["NATION_1", flt.CITY_FILL["PREF_CITY"]], "AVG_ATM_TRN_CNT": None})


def q_filter_options_cascade(spark, root):
    """what each control offers under the choices before it."""
    return flt.filter_options_cascade(_seg(spark, root), CASCADE)


def q_filter_options_text(spark, root):
    return flt.category_options(d.table(spark, root, "orders"), "o_orderpriority")


def q_filter_options_dates(spark, root):
    out = flt.date_options(d.table(spark, root, "orders"), ["o_orderdate"])
    return out.select("column_name", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("min_date", "max_date")])


def q_filter_regex(spark, root):
    c = d.table(spark, root, "customer")
    return flt.apply_filters(c, [flt.RegexFilter("c_name", REGEX)]).select("c_custkey", "c_name")


def q_filter_options(spark, root):
    seg = flt.apply_filters(_seg(spark, root), flt.from_form(members={"SOC_SEG": ["BUILDING"]}))
    out = flt.numeric_options(seg, ["MONTHLY_INCOME", "TENURE", "AVG_MB_IB_TRN_CNT", "URGENT_AVG_AMT"])
    return _round_cols(out, ["min_value", "max_value"])


# ---------------------------------------------------------------------------
# Channel aggregates
# ---------------------------------------------------------------------------

def q_channel_activity(spark, root):
    return wide.channel_activity(spark, root)


def q_channel_amounts(spark, root):
    blk = wide.event_channel_block(spark, root)
    return blk.select(d.KEY, *[d.CHANNEL_NAMES[c][1] for c in ("MB_IB", "POS", "ATM")])


def q_channel_digital(spark, root):
    return wide.event_channel_block(spark, root, channels=["MB_IB"])


def q_channel_pos(spark, root):
    return wide.event_channel_block(spark, root, channels=["POS"])


def q_channel_atm(spark, root):
    return wide.event_channel_block(spark, root, channels=["ATM"])


def q_channel_branch(spark, root):
    return wide.branch_block(spark, root)


# ---------------------------------------------------------------------------
# Statistics and profile
# ---------------------------------------------------------------------------

def q_cluster_describe(spark, root):
    desc = st.describe_by(_lineitem_labelled(spark, root), "Cluster", LI_DESCRIBE)
    return _round_cols(desc, ["mean", "std", "min", "p25", "p50", "p75", "max"])


def q_population_metrics(spark, root):
    return st.population_metrics(_seg(spark, root))


def q_cluster_share(spark, root):
    return st.cluster_share(_lineitem_labelled(spark, root), "Cluster")


def q_correlation_long(spark, root):
    return st.correlation_long(_seg(spark, root), CORR_VARS)


def q_correlation_lower(spark, root):
    return st.correlation_long(_seg(spark, root), CORR_VARS, lower_only=True)


def wide_numbers() -> list[str]:
    """More than 64 numeric columns: those of the wide row, and each model variable times the next."""
    names = [*d.MODEL_VARIABLES, *d.CUSTOMER_FACT, *d.SEGMENT_FACT]
    return names + [f"{a} * {b}" for a, b in zip(d.MODEL_VARIABLES, d.MODEL_VARIABLES[1:])]


def q_correlation_wide(spark, root):
    """A13 over all numeric columns of the wide row and products of them."""
    exprs = wide_numbers()
    seg = _seg(spark, root).select(*[F.expr(f"CAST({e} AS double)").alias(e) for e in exprs])
    return st.correlation_long(seg.toDF(*[f"v{i:03d}" for i in range(len(exprs))]), [f"v{i:03d}" for i in range(len(exprs))], lower_only=True)


def _lineitem_prices(spark, root):
    li = d.table(spark, root, "lineitem")
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.select("l_quantity", "l_extendedprice", disc.alias("disc_price"),
                     (disc * (1 + F.col("l_tax"))).alias("charge"))


def q_redundant_pairs(spark, root):
    return st.redundant_pairs(st.correlation_long(_lineitem_prices(spark, root), PRICE_VARS, lower_only=True, digits=None), digits=2)


def q_profile_long(spark, root):
    return st.profile_long(_lineitem_labelled(spark, root), LI_DESCRIBE, "Cluster")


def q_profile_wide(spark, root):
    return st.profile_wide(st.profile_long(_lineitem_labelled(spark, root), LI_DESCRIBE, "Cluster"), LI_K)


# ---------------------------------------------------------------------------
# Row preparation
# ---------------------------------------------------------------------------

def q_dedup_first(spark, root):
    o = d.table(spark, root, "orders")
    return dedup_first(o, "o_custkey", ["o_orderdate", "o_orderkey"])


def q_month_end(spark, root):
    o = d.table(spark, root, "orders")
    prev = month_end("o_orderdate", 1)
    return o.select("o_orderkey", F.date_format(F.last_day("o_orderdate"), "yyyy-MM-dd").alias("SNAP_DATE"),
                    F.date_format(prev, "yyyy-MM-dd").alias("PREV_MONTH_END"),
                    snapshot_label(prev).alias("SNAP_LABEL"))


def q_impute_defaults(spark, root):
    seg = _seg(spark, root).select(d.KEY, *IMPUTE_TEXT, *IMPUTE_NUM)
    return impute_defaults(seg, IMPUTE_TEXT, IMPUTE_NUM)


def q_city_fill(spark, root):
    return impute_defaults(_city_frame(spark, root), {"PREF_CITY": flt.CITY_FILL["PREF_CITY"]})


def q_parse_dates(spark, root):
    """A text column of dates becomes a timestamp, one with other text in it stays text."""
    o = d.table(spark, root, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderpriority").alias("other"))
    out = parse_all_valid(o, ["day", "other"])
    return out.select("o_orderkey", F.date_format(F.col("day") + F.expr("INTERVAL 36 HOURS"), "yyyy-MM-dd HH:mm").alias("later"), "other")


def q_strip_timezone(spark, root):
    e = d.table(spark, root, "events")
    return e.select("event_id", strip_timezone(F.col("ts").cast("timestamp")).cast("string").alias("wall_clock"))


def q_cap_value(spark, root):
    seg = _seg(spark, root)
    return seg.select(d.KEY, cap_value("TENURE", 30.0).alias("TENURE_CAPPED"),
                      cap_value("AVG_MB_IB_TRN_CNT", 10.0).alias("MB_IB_CNT_CAPPED"))


def q_flag_to_int(spark, root):
    o = d.table(spark, root, "orders")
    return o.select("o_orderkey", flag_to_int(F.substring("o_orderpriority", 1, 1)).alias("URGENT_FLAG"))


# ---------------------------------------------------------------------------
# Modelling
# ---------------------------------------------------------------------------

def q_standardize(spark, root):
    seg = _seg(spark, root)
    return _round_cols(mdl.standardize(seg, SEG_MODEL, keep=[d.KEY]), SEG_MODEL)


def q_prepare_features(spark, root):
    return _round_cols(mdl.prepare_features(_seg(spark, root), SEG_MODEL, keep=[d.KEY]), SEG_MODEL)


def _li_centres(spark, root):
    cen = mdl.centroid_update(_lineitem_labelled(spark, root), LI_MODEL, "Cluster")
    return _round_cols(cen, LI_MODEL)


def q_centroid_update(spark, root):
    return _li_centres(spark, root)


def q_assign_nearest(spark, root):
    ids, centres = mdl.collect_centres(_li_centres(spark, root), LI_MODEL, "Cluster", LI_K)
    li = _lineitem_labelled(spark, root)
    out = mdl.assign_nearest(li, LI_MODEL, centres, "Nearest")
    mapped = F.element_at(F.array(*[F.lit(i) for i in ids]), F.col("Nearest") + 1)
    return out.select("l_orderkey", "l_linenumber", mapped.alias("Nearest"))


def wide_points() -> tuple[list[str], list[list[float]]]:
    """21 expressions over a line and 30 centres, by rule."""
    base = ["l_quantity", "l_extendedprice / 1000", "l_discount * 100"]
    return [f"({base[i % 3]}) * {1 + i // 3}" for i in range(21)], [[float((j + 1) * (i % 5 + 1)) for i in range(21)] for j in range(30)]


def q_assign_nearest_wide(spark, root):
    """M4 at the largest size the application offers: 30 centres over 21 variables."""
    exprs, centres = wide_points()
    cols = [f"v{i}" for i in range(21)]
    li = d.table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", *[F.expr(e).cast("double").alias(c) for c, e in zip(cols, exprs)])
    return mdl.assign_nearest(li, cols, centres, "Nearest").select("l_orderkey", "l_linenumber", "Nearest")


def q_inertia_given_labels(spark, root):
    out = mdl.inertia(_lineitem_labelled(spark, root), LI_MODEL, "Cluster", _li_centres(spark, root))
    return _round_cols(out, ["inertia"], 4)


def _model_input(spark, root):
    return mdl.prepare_features(_seg(spark, root), SEG_MODEL, keep=[d.KEY])


def q_kmeans_fit(spark, root):
    points = _model_input(spark, root)
    fit = mdl.fit_kmeans(points, SEG_MODEL, FINAL_K, key=d.KEY)
    return mdl.label(fit, points, SEG_MODEL, "Cluster").select(d.KEY, "Cluster")


def q_elbow_curve(spark, root):
    curve = mdl.elbow_curve(_model_input(spark, root), SEG_MODEL, ELBOW_K_MAX, key=d.KEY)
    return _round_cols(curve, ["Inertia"])


def q_segment_customers(spark, root):
    client, _ = mdl.segment(_seg(spark, root), d.KEY, SEG_MODEL, SEG_REPORT, FINAL_K)
    return client


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
