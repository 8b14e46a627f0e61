"""The filter form: options under earlier choices (F18), kinds from sketches (F13), types in one pass (X13), regex dialect."""

import datetime as dt
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from segmint.functions import prep
from segmint.operators import filters as flt

COLUMNS = ["seg", "income", "city", "day", "name", "AVG_ATM_TRN_CNT"]


def people(n=600):
    rng = random.Random(9)
    out = []
    for i in range(n):
        maybe = lambda v: None if rng.random() < 0.1 else v
        out.append((i, maybe(rng.choice("ABCD")), maybe(float(rng.randint(-20, 300))), maybe(f"city{rng.randint(0, 95)}"),
                    maybe(dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * rng.randint(0, 300))), maybe(f"n{i}"), maybe(float(rng.randint(0, 5)))))
    return out


SCHEMA = "id int, seg string, income double, city string, day timestamp_ntz, name string, AVG_ATM_TRN_CNT double"


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(people(), SCHEMA).repartition(5)


def plain_form(rows, criteria, cut=88):
    """The form with plain loops: (options, ids left)."""
    df = pd.DataFrame(rows, columns=["id", *COLUMNS]).astype(object).where(lambda x: x.notna(), None)
    out = []
    for j, (c, v) in enumerate(criteria.items()):
        values = [x for x in df[c] if x is not None]
        listed = len(set(values)) < cut and c != "AVG_ATM_TRN_CNT"
        times, numbers = c == "day", c in ("income", "AVG_ATM_TRN_CNT")
        if listed:
            for x in set(df[c]):
                n = sum((y is None) if x is None else y == x for y in df[c])
                text = None if x is None else x.strftime("%Y-%m-%d %H:%M:%S") if times else str(x)
                out.append((j, c, "categorical", text, n, None, None, None, None))
        elif numbers:
            out.append((j, c, "numeric", None, len(df), 0.0, max(values, default=None), None, None))
        elif times:
            out.append((j, c, "datetime", None, len(df), None, None, str(min(values).date()), str(max(values).date())))
        else:
            out.append((j, c, "text", None, len(df), None, None, None, None))
        if v is None and listed:
            keep = lambda x: False
        elif v is None and numbers:
            keep = lambda x: x is not None and x >= 0
        elif v is None and times:
            lo, hi = (dt.datetime.combine(f(values).date(), dt.time()) for f in (min, max))
            keep = lambda x, lo=lo, hi=hi: x is not None and lo <= x <= hi
        elif v is None:
            keep = lambda x: True
        elif isinstance(v, str):
            keep = lambda x, v=v: x is not None and re.search(v, x) is not None
        elif isinstance(v, tuple):
            keep = lambda x, v=v: x is not None and v[0] <= x <= v[1]
        else:
            keep = lambda x, v=v: x in v
        df = df[pd.Series([bool(keep(x)) for x in df[c]], index=df.index, dtype=bool)]
    return sorted(out, key=str), sorted(df["id"])


FORMS = [
    {"seg": ["A", "B", None], "income": (0.0, 250.0), "city": None},
    {"income": None, "day": None, "name": None, "seg": ["A"], "AVG_ATM_TRN_CNT": None, "city": None},
    {"day": None, "income": None, "AVG_ATM_TRN_CNT": None, "name": "[37]$", "city": None},
    {"seg": None, "income": None, "AVG_ATM_TRN_CNT": None, "day": None},          # an untouched list leaves nothing
    {"seg": [], "income": (0.0, 1.0), "city": ["city1"]},
    {"city": ["city1", "city2", "nowhere", None], "income": None, "seg": ["C"]},
    {"AVG_ATM_TRN_CNT": None},
]


@pytest.mark.parametrize("form", FORMS, ids=lambda f: ",".join(f))
def test_options_and_rows_against_plain_loops(frame, form):
    options, ids = plain_form(people(), form)
    got = flt.filter_options_cascade(frame, form)
    assert sorted(map(tuple, got.collect()), key=str) == options
    assert sorted(r.id for r in flt.filter_auto(frame, form).select("id").collect()) == ids


def test_one_table_of_values_is_read(frame):
    plan = flt.filter_options_cascade(frame, FORMS[1])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_empty_frame(spark):
    none = spark.createDataFrame([], SCHEMA)
    form = {"seg": ["A"], "income": None, "AVG_ATM_TRN_CNT": None, "day": None, "name": "x"}
    got = [tuple(r)[:5] for r in flt.filter_options_cascade(none, form).collect()]
    assert got == [(2, "AVG_ATM_TRN_CNT", "numeric", None, 0)] and flt.filter_auto(none, form).count() == 0
    with pytest.raises(ValueError):
        flt.filter_options_cascade(none, {})


def jobs(spark, action):
    sc = spark.sparkContext
    group = f"jobs-{random.random()}"
    sc.setJobGroup(group, "")
    try:
        action()
    finally:
        sc.setJobGroup("other", "")
    return len(sc.statusTracker().getJobIdsForGroup(group))


def test_jobs_do_not_grow_with_controls(spark, frame):
    one = jobs(spark, lambda: flt.filter_auto(frame, {"income": None}))
    many = jobs(spark, lambda: flt.filter_auto(frame, {"income": None, "name": None, "AVG_ATM_TRN_CNT": None, "city": None, "seg": None}))
    assert many <= one + 1
    texts = spark.range(50).select(*[F.concat(F.lit("2024-01-0"), (F.col("id") % 9 + 1).cast("string")).alias(c) for c in flt.FILTER_COLUMNS])
    assert jobs(spark, lambda: flt.prepare_filters(texts, flt.FILTER_COLUMNS, {})) <= jobs(spark, lambda: texts.agg(F.count("*")).first())


def test_sketch_proves_only_what_holds(spark):
    assert flt.sketch_limit(88) == 88
    df = spark.range(4000).select(*[(F.col("id") % n).alias(f"c{n}") for n in (86, 87, 88, 89, 90, 200, 4000)], F.lit(None).cast("long").alias("none"))
    kinds = flt.column_kinds(df, df.columns)
    assert kinds == {f"c{n}": "categorical" if n < 88 else "numeric" for n in (86, 87, 88, 89, 90, 200, 4000)} | {"none": "categorical"}
    sketch = df.agg(*[F.approx_count_distinct(c, flt.SKETCH_ERROR).alias(c) for c in df.columns]).first()
    assert sketch["c87"] <= flt.sketch_limit(88) < sketch["c200"]


def test_types_in_one_pass(spark):
    df = spark.createDataFrame([("2024-01-01", "x", None, 1), (None, "2024-01-02", None, 2)], "a string, b string, c string, d int")
    assert [t for _, t in prep.parse_all_valid(df, ["a", "b", "c", "d"]).dtypes] == ["timestamp", "string", "timestamp", "int"]
    assert prep.parse_all_valid(df, []).columns == df.columns


def test_python_patterns(spark):
    df = spark.createDataFrame([("abab",), ("abba",), ("ab\n",), ("a\\Z",)], "s string")
    found = lambda p: sorted(r.s for r in flt.apply_filters(df, [flt.RegexFilter("s", p)]).collect())
    for p in (r"^(?P<x>ab)(?P=x)$", r"ab\Z", r"\\Z", "b+"):
        assert found(p) == sorted(r.s for r in df.collect() if re.search(p, r.s))
    for p in ("(?P<a_b>x)", "(a)?(?(1)b|c)"):
        with pytest.raises(ValueError):
            found(p)
    with pytest.raises(re.error):
        found("(")
