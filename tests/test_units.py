"""Hand-made frames for nulls, edges and the quirks of SURVEY 2.12 / 2.13."""

import datetime as dt
import math
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmint.functions import dates, prep
from segmint.operators import features as feat
from segmint.operators import filters as flt
from segmint.operators import stats as st
from segmint.sources import snapshots as snap


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# --- f_null_range / f_members (F9-F11, F14, Q6, Q7, Q11) -----------------------

@pytest.fixture()
def people(spark):
    data = [(1, 10.0, "A"), (2, None, "B"), (3, float("nan"), None), (4, 0.0, "C"),
            (5, 20.0, "A"), (6, 20.000001, "Z")]
    return spark.createDataFrame(data, "id long, x double, cat string")


def test_range_bounds_closed_null_fails(people):
    out = flt.apply_filters(people, [flt.RangeFilter("x", (10.0, 20.0))])
    assert rows(out, "id") == [(1,), (5,)]


def test_sentinel_means_off(people):
    out = flt.apply_filters(people, flt.from_form(ranges={"x": (0.0, 0.0)}))
    assert out.count() == 6


def test_optional_empty_list_is_off_mandatory_gives_nothing(people):
    assert flt.apply_filters(people, [flt.MemberFilter("cat", [])]).count() == 6
    assert flt.apply_filters(people, [flt.MemberFilter("cat", [])], mandatory=True).count() == 0
    assert flt.apply_filters(people, [flt.RangeFilter("x", None)], mandatory=True).count() == 0


def test_member_null_only_when_chosen(people):
    assert rows(flt.apply_filters(people, [flt.MemberFilter("cat", ["A"])]), "id") == [(1,), (5,)]
    out = flt.apply_filters(people, [flt.MemberFilter("cat", ["A", None])])
    assert rows(out, "id") == [(1,), (3,), (5,)]


def test_nan_to_null_and_impute(people):
    clean = prep.nan_to_null(people)
    assert clean.where(F.col("x").isNull()).count() == 2
    filled = prep.impute_defaults(people, text={"cat": "Undefined"}, numbers={"x": 0})
    assert rows(filled, "id", "x", "cat")[1] == (2, 0.0, "B")
    assert rows(filled, "id", "x", "cat")[2] == (3, 0.0, "Undefined")


def test_fill_selected_writes_text_zero(people):
    out = prep.fill_selected(people, ["x", "cat"], 0, "0")
    assert rows(out, "id", "cat")[2] == (3, "0")
    keep = prep.fill_selected(people, ["x", "cat"], 0, None)
    assert rows(keep, "id", "cat")[2] == (3, None)


def test_filter_segment_conjunction(people):
    out = flt.filter_segment(people, {"x": (5.0, 25.0)}, {"cat": ["A", "Z"]})
    assert rows(out, "id") == [(1,), (5,), (6,)]


# --- type-driven dispatch (F13-F18) ---------------------------------------------

def test_filter_auto_dispatch(spark):
    data = [(i, float(i), "A" if i % 2 else "B", f"n{i}", dt.datetime(2020, 1, 1) + dt.timedelta(days=i))
            for i in range(200)]
    df = spark.createDataFrame(data, "id long, x double, cat string, name string, ts timestamp")
    kinds = flt.column_kinds(df, ["x", "cat", "name", "ts"])
    assert kinds == {"x": "numeric", "cat": "categorical", "name": "text", "ts": "datetime"}
    out = flt.filter_auto(df, {"cat": ["A"], "x": (10.0, 120.0), "name": "1[13]$",
                               "ts": ("2020-01-12", "2020-04-30")})
    assert rows(out, "id") == [(11,), (13,), (111,), (113,)]
    # after narrowing to < 88 rows, x is categorical (the reference's rule); a
    # range on it is the same rows as ticking every value inside the range
    small = df.where(F.col("id") < 50)
    assert flt.column_kinds(small, ["x"]) == {"x": "categorical"}
    assert flt.filter_auto(small, {"x": (1.0, 2.0)}).count() == 2
    assert flt.filter_auto(small, {"x": [1.0, 2.0, 99.0]}).count() == 2


def test_untouched_date_control_ends_at_midnight(spark):
    rows_ = [(1, dt.datetime(2024, 1, 1, 9)), (2, dt.datetime(2024, 1, 2)), (3, dt.datetime(2024, 1, 3)), (4, dt.datetime(2024, 1, 3, 0, 1)), (5, None)]
    df = spark.createDataFrame(rows_, "id int, ts timestamp")
    assert rows(flt.filter_auto(df, {"ts": None}, kinds={"ts": "datetime"}), "id") == [(1,), (2,), (3,)]


def test_filter_panel(spark):
    df = spark.createDataFrame([(1, None, 3.0, "2024-01-01"), (2, "A", 5.0, "2024-02-01"), (3, "B", None, "2024-03-01")],
                               "id int, PREF_CITY string, AVG_ATM_TRN_CNT double, PAYROLL_TP string")
    prepared = flt.prepare_filters(df)
    assert dict(prepared.dtypes)["PAYROLL_TP"] == "timestamp_ntz" and prepared.where("PREF_CITY IS NULL").count() == 0
    assert rows(flt.filter_panel(df, {"PREF_CITY": ["A", flt.CITY_FILL["PREF_CITY"]], "AVG_ATM_TRN_CNT": None}), "id") == [(1,), (2,)]
    with pytest.raises(ValueError):
        flt.filter_panel(df, {"id": [1]})
    exact = spark.range(88).selectExpr("id", "id % 87 AS few")
    assert flt.column_kinds(exact, ["id", "few"]) == {"id": "numeric", "few": "categorical"}


def test_filter_auto_untouched_defaults(spark):
    d = [(1, -5.0, "a", dt.datetime(2020, 1, 1)), (2, 3.0, "b", None), (3, None, "a", dt.datetime(2020, 1, 2))]
    df = spark.createDataFrame(d, "id long, x double, cat string, ts timestamp")
    assert flt.filter_auto(df, {"cat": None}).count() == 0                      # empty multiselect
    assert rows(flt.filter_auto(df, {"x": None}, kinds={"x": "numeric"}), "id") == [(2,)]   # (0, max)
    assert rows(flt.filter_auto(df, {"ts": None}, kinds={"ts": "datetime"}), "id") == [(1,), (3,)]
    assert flt.filter_auto(df, {"cat": "zz" and None}, kinds={"cat": "text"}).count() == 3


def test_regex_null_never_matches(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "xbz")], "id long, s string")
    assert rows(flt.apply_filters(df, [flt.RegexFilter("s", "b")]), "id") == [(1,), (3,)]
    assert flt.apply_filters(df, [flt.RegexFilter("s", "")]).count() == 3


def test_options(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,)], "x double")
    r = flt.numeric_options(df, ["x"]).first()
    assert (r.column_name, r.n_distinct, r.min_value, r.max_value) == ("x", 2, 1.0, 2.0)


# --- dates and snapshots (X1-X3, S4-S7, F7, Q1, Q2) -------------------------------

def test_month_ends():
    assert dates.month_end_of(dt.date(2024, 3, 31), 1) == dt.date(2024, 2, 29)
    assert dates.month_end_of(dt.date(2024, 1, 15), 1) == dt.date(2023, 12, 31)
    assert dates.month_end_of(dt.date(2024, 1, 31), 3) == dt.date(2023, 10, 31)
    assert dates.snapshot_label_of(dt.date(2024, 3, 5)) == "2024_02_29"


def test_month_snapshots_equals_union(spark):
    d = [(1, dt.date(2024, 2, 29)), (2, dt.date(2024, 1, 31)), (3, dt.date(2023, 12, 31)),
         (4, dt.date(2023, 11, 30))]
    df = spark.createDataFrame(d, "id long, snap_date date")
    a = snap.month_snapshots(df, dt.date(2024, 3, 31))
    b = snap.union_months(df, dt.date(2024, 3, 31))
    assert rows(a, "id") == rows(b, "id") == [(1,), (2,), (3,)]


def test_window_edge_midnight(spark):
    d = [(1, dt.datetime(2024, 1, 31, 0, 0)), (2, dt.datetime(2024, 1, 31, 10, 0)),
         (3, dt.datetime(2023, 11, 30, 0, 0)), (4, dt.datetime(2023, 11, 29, 23, 59))]
    df = spark.createDataFrame(d, "id long, ts timestamp")
    lo, hi = dates.month_end_of(dt.date(2024, 2, 15), 3), dates.month_end_of(dt.date(2024, 2, 15), 1)
    out = df.where(F.col("ts").between(F.lit(lo), F.lit(hi)))
    assert rows(out, "id") == [(1,), (3,)]


def test_snapshot_or_build(spark, tmp_dir):
    calls = []

    def builder(month_end):
        calls.append(month_end)
        return spark.createDataFrame([(1, "a")], "id long, v string")

    root = f"{tmp_dir}/snaps"
    first = snap.snapshot_or_build(spark, root, dt.date(2024, 3, 10), builder)
    again = snap.snapshot_or_build(spark, root, dt.date(2024, 3, 10), builder)
    assert first.count() == again.count() == 1
    assert calls == [dt.date(2024, 2, 29)]
    assert snap.snapshot_exists(spark, root, dt.date(2024, 2, 29))


# --- pivots, channels, joins (A1-A9, J1, J3, T5-T7, Q12) --------------------------

def test_pivot_unlisted_only_person_keeps_null_row(spark):
    d = [(1, "a", 1, Decimal("1.00")), (1, "a", 2, None), (1, "b", 1, Decimal("2.50")),
         (2, "zzz", 1, Decimal("9.00")), (3, None, 1, Decimal("1.00"))]
    df = spark.createDataFrame(d, "k long, cls string, cnt long, amt decimal(18,2)")
    out = feat.category_sums(df, "k", "cls", {"a": "A", "b": "B"}, "cnt", "amt")
    got = {r.k: r for r in out.collect()}
    assert (got[1].A_SUM_CNT, got[1].A_SUM_AMT, got[1].B_SUM_CNT) == (3.0, 1.0, 1.0)
    assert got[2].A_SUM_CNT is None and got[2].B_SUM_AMT is None
    assert 3 in got
    avg = feat.category_averages(df, "k", "cls", {"a": "A"}, 3, "cnt", "amt")
    assert {r.k: r.A_AVG_CNT for r in avg.collect()}[1] == 1.0


def test_channel_half_cents_round_half_up(spark):
    # sums whose third is an exact tie at one decimal: 0.45 -> 0.5, 0.15 -> 0.2
    d = [(1, "x", Decimal("1.35")), (2, "x", Decimal("0.45")), (3, "y", Decimal("5.00")),
         (4, "x", Decimal("-1.00"))]
    df = spark.createDataFrame(d, "k long, t string, amt decimal(18,2)")
    out = feat.channel_averages(df, "k", {"X": F.col("t") == "x", "Y": F.col("t") == "y"}, "amt",
                                common=F.col("amt") > 0)
    got = {r.k: r for r in out.collect()}
    assert got[1].AVG_X_AMT == 0.5 and got[2].AVG_X_AMT == 0.2
    assert got[3].AVG_X_CNT is None and got[3].AVG_X_AMT is None   # no rows -> null, not 0
    assert 4 not in got                                             # amounts <= 0 excluded


def test_semi_join_dup_and_null_keys(spark):
    base = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    other = spark.createDataFrame([(1,), (1,), (None,)], "k long")
    assert rows(feat.semi_join(base, other, "k"), "k") == [(1,)]


def test_left_join_fanout_is_visible(spark):
    base = spark.createDataFrame([(1,), (2,)], "k long")
    blk = spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    assert feat.attach(base, "k", [blk]).count() == 3
    assert feat.key_duplicates(blk, "k").count() == 1


# --- flags, caps, text dates (X11-X14, Q3) ----------------------------------------

def test_flags(spark):
    df = spark.createDataFrame([("1",), ("0",), (None,), ("yes",)], "f string")
    assert [r[0] for r in df.select(prep.flag_to_int("f")).collect()] == [1, 0, 0, 0]


def test_cap(spark):
    df = spark.createDataFrame([(None,), (30.0,), (31.0,), (-2.0,)], "t double")
    assert [r[0] for r in df.select(prep.cap_value("t", 30.0)).collect()] == [0.0, 30.0, 30.0, -2.0]


def test_parse_all_or_nothing(spark):
    good = spark.createDataFrame([("2024-01-01",), ("2024-02-03 10:00:00",), (None,)], "s string")
    bad = spark.createDataFrame([("2024-01-01",), ("not a date",)], "s string")
    assert str(prep.parse_when_all_valid(good, "s").schema["s"].dataType).startswith("Timestamp")
    assert str(prep.parse_when_all_valid(bad, "s").schema["s"].dataType) == "StringType()"


def test_dedup_first(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (1, 1, "b"), (2, 5, "z")], "k long, o long, v string")
    assert rows(prep.dedup_first(df, "k", ["o"]), "k", "o", "v") == [(1, 1, "a"), (2, 5, "z")]


# --- statistics (A10-A15, T1, T12) -------------------------------------------------

def _np_quart(vals):
    return [float(np.quantile(vals, p)) for p in (0.25, 0.5, 0.75)] if vals else [None] * 3


@pytest.mark.parametrize("partitions", [1, 7])
def test_quartiles_match_numpy(spark, partitions):
    rng = np.random.default_rng(7)
    groups = {0: [5.0], 1: [1.0, 2.0], 2: list(rng.integers(0, 5, 40).astype(float)),
              3: list(rng.normal(size=301)), 4: [2.0, 2.0, 2.0, 3.0], None: [1.0, 2.0, 3.0, 5.0],
              6: list(rng.normal(size=20_000)), 7: [0.0] * 9000 + list(rng.normal(size=1000)), 8: list(rng.integers(0, 9, 5000).astype(float))}
    data = [(g, float(v)) for g, vs in groups.items() for v in vs] + [(5, None)]
    df = spark.createDataFrame(data, "g int, value double").repartition(partitions)
    out = st.exact_quantiles(df, ["g"], "value")
    got = {}
    for r in out.collect():
        got.setdefault(r.g, {})[r.p] = r.q
    for g, vs in groups.items():
        want = _np_quart(vs)
        for p, w in zip((0.25, 0.5, 0.75), want):
            assert math.isclose(got[g][p], w, rel_tol=1e-12, abs_tol=1e-12), (g, p, got[g][p], w)
    assert 5 not in got
    everything = {r.p: r.q for r in st.exact_quantiles(df, [], "value").collect()}
    assert np.allclose([everything[p] for p in (0.25, 0.5, 0.75)], _np_quart([v for _, v in data if v is not None]))


def test_describe_one_row_std_null(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 1.0), (1, 3.0)], "Cluster int, x double")
    got = {r.Cluster: r for r in st.describe_by(df, "Cluster", ["x"]).collect()}
    assert got[0]["std"] is None and got[0]["count"] == 1
    assert got[1]["mean"] == 2.0 and math.isclose(got[1]["std"], math.sqrt(2.0))


def test_corr_constant_and_one_sided_nulls(spark):
    d = [(1.0, 2.0, 5.0), (2.0, None, 5.0), (3.0, 6.0, 5.0), (4.0, 8.1, 5.0), (None, 1.0, 5.0)]
    df = spark.createDataFrame(d, "a double, b double, c double")
    got = {(r.var_x, r.var_y): r.r for r in st.correlation_long(df, ["a", "b", "c"], digits=None).collect()}
    import pandas as pd
    pdf = pd.DataFrame(d, columns=["a", "b", "c"])
    assert math.isclose(got[("b", "a")], pdf.corr().loc["a", "b"], rel_tol=1e-12)
    assert got[("c", "a")] is None                      # constant column: null, no ANSI error
    assert got[("a", "b")] == got[("b", "a")]
    lower = st.correlation_long(df, ["a", "b", "c"], lower_only=True)
    assert lower.count() == 6


def test_share_rounds_like_numpy(spark):
    df = spark.createDataFrame([(0,)] * 1 + [(1,)] * 31, "Cluster int")
    got = {r.Cluster: r.CountShare for r in st.cluster_share(df).collect()}
    assert got[0] == float(np.round(100 / 32, 2))        # 3.125 -> 3.12 (half to even)
    assert got[1] == float(np.round(100 * 31 / 32, 2))


def test_describe_keeps_null_groups_and_empty_variables(spark):
    df = spark.createDataFrame([(0, None, 1.0), (0, None, 2.0), (None, 1.0, 4.0), (None, 3.0, None), (1, 5.0, 6.0)], "Cluster int, x double, y double")
    got = {(r.variable, r.Cluster): r for r in st.describe_by(df, "Cluster", ["x", "y"]).collect()}
    assert set(got) == {(v, c) for v in ("x", "y") for c in (0, None, 1)}
    assert got["x", 0]["count"] == 0 and got["x", 0]["mean"] is None and got["x", 0]["p50"] is None
    assert [got["x", None][c] for c in ("count", "p25", "p50", "p75")] == [2, 1.5, 2.0, 2.5]
    prof = {(r.row_label, r.Cluster): r.value for r in st.profile_long(df.where("Cluster is not null"), ["x", "y"]).collect()}
    assert prof["Count", 0] == 0 and prof["CountShare %", 0] == 0 and prof["CountShare %", 1] == 100


def test_profile_wide_refuses_labels_outside(spark):
    df = spark.createDataFrame([(1, 1.0), (3, 2.0)], "Cluster int, x double")
    long = st.profile_long(df, ["x"])
    assert st.profile_wide(long, 4).count() == 8
    for bad in (long.where("Cluster = 3"), long.withColumn("Cluster", F.lit(None).cast("int"))):
        with pytest.raises(Exception, match="label outside"):
            st.profile_wide(bad, 3).collect()


def test_redundant_pairs_test_the_unrounded_r(spark):
    x = np.arange(40.0)
    rng = np.random.default_rng(0)
    noise = rng.normal(size=40)
    noise -= noise.mean() + (noise @ (x - x.mean())) / ((x - x.mean()) @ (x - x.mean())) * (x - x.mean())
    target = 0.8013
    y = (x - x.mean()) / x.std() * target + noise / noise.std() * math.sqrt(1 - target ** 2)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    found = st.redundant_pairs(st.correlation_long(df, ["x", "y"], lower_only=True, digits=None), digits=2).collect()
    assert [(r.var_x, r.var_y, r.r) for r in found] == [("y", "x", 0.8)]


def test_correlation_with_a_far_value_where_the_other_is_null(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=400)
    b = a + 0.3 * rng.normal(size=400)
    rows = [(float(x), float(y), 5.1, float(x) + 1e9) for x, y in zip(a, b)] + [(-1e8, None, 5.1, None), (None, 1e12, 5.1, None), (None, None, None, -1e15)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = {(r.var_x, r.var_y): r.r for r in st.correlation_long(df, ["a", "b", "c", "d"], lower_only=True, digits=None).collect()}
    want = np.corrcoef(a, b)[0, 1]
    assert math.isclose(got["b", "a"], want, rel_tol=1e-12)
    assert math.isclose(got["d", "b"], want, rel_tol=1e-6) and math.isclose(got["d", "a"], 1.0, rel_tol=1e-6)
    assert got["c", "a"] is None and got["c", "c"] is None and len(got) == 10
    assert ("b", "a") in {(r.var_x, r.var_y) for r in st.redundant_pairs(st.correlation_long(df, ["a", "b"], lower_only=True, digits=None)).collect()}


def test_correlation_of_many_variables_and_null_patterns(spark):
    import pandas as pd
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 21)) @ rng.normal(size=(21, 21)) + 1e6
    x[rng.random(x.shape) < 0.05] = np.nan
    cols = [f"v{i}" for i in range(21)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"{c} double" for c in cols)).repartition(6)
    want = pd.DataFrame(x, columns=cols).corr()
    got = st.correlation_long(df, cols, digits=None).collect()
    assert len(got) == 441 and all(math.isclose(r.r, want.loc[r.var_x, r.var_y], abs_tol=1e-8) for r in got)


def test_select_variables_overlap_and_unknown(people):
    out = prep.select_variables(people, "id", ["x", "x"], ["cat", "x", "id"])
    assert out.columns == ["id", "x", "cat"]
    with pytest.raises(ValueError):
        prep.select_variables(people, "id", ["nope"])


def test_strip_timezone_keeps_wall_clock(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 31, 10, 30),)], "ts timestamp")
    out = df.select(prep.strip_timezone("ts").alias("t"))
    assert str(out.schema["t"].dataType) == "TimestampNTZType()"
    assert out.first().t == dt.datetime(2024, 1, 31, 10, 30)


def test_category_options_and_approx_counts(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), (None, 4.0)], "c string, x double")
    got = {r.value: r.n_rows for r in flt.category_options(df, "c").collect()}
    assert got == {"a": 2, "b": 1, None: 1}
    r = flt.numeric_options(df, ["x"], exact=False).first()
    assert (r.n_distinct, r.min_value, r.max_value) == (3, 1.0, 4.0)


def test_cluster_conf_sizes_partitions():
    from segmint.session import cluster_conf
    conf = cluster_conf(100 * 1024 ** 4, 8000)
    assert conf["spark.sql.shuffle.partitions"] == str(100 * 1024 ** 4 // (256 << 20))
    assert int(cluster_conf(1, 16)["spark.sql.shuffle.partitions"]) == 32
