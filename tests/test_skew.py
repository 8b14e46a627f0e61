"""One key with a third of all rows: results stay whole and exact.

Spread over many partitions, the hot key must pass through partial
aggregation (pivots, channels, dedup, distinct keys of a semi join) and the
ranked quantile path (which splits the hot group across tasks).
"""

import math
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from segmint.functions import prep
from segmint.operators import features as feat
from segmint.operators import stats as st


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(23)
    n = 6000
    keys = np.where(np.arange(n) % 3 == 0, 7, rng.integers(100, 400, n))   # key 7 holds 1/3
    cls = rng.choice(["a", "b", "c"], n)
    cents = rng.integers(1, 100_000, n)
    pdf = pd.DataFrame({"k": keys.astype("int64"), "cls": cls, "cnt": np.ones(n, dtype="int64"),
                        "amt": [Decimal(int(c)) / 100 for c in cents], "o": np.arange(n, dtype="int64"),
                        "x": rng.normal(size=n)})
    df = spark.createDataFrame(pdf, "k long, cls string, cnt long, amt decimal(18,2), o long, x double")
    return pdf, df.repartition(12)


def test_pivot_on_hot_key(skewed):
    pdf, df = skewed
    out = {r.k: r for r in feat.category_sums(df, "k", "cls", {"a": "A", "b": "B"}, "cnt", "amt").collect()}
    hot = pdf[pdf.k == 7]
    assert out[7].A_SUM_CNT == float((hot.cls == "a").sum())
    assert Decimal(str(out[7].B_SUM_AMT)) == sum(hot[hot.cls == "b"].amt)
    assert len(out) == pdf.k.nunique()


def test_channels_on_hot_key(skewed):
    pdf, df = skewed
    out = {r.k: r for r in feat.channel_averages(df, "k", {"C": F.col("cls") == "c"}, "amt").collect()}
    hot = pdf[(pdf.k == 7) & (pdf.cls == "c")]
    want = (sum(hot.amt) / 3).quantize(Decimal("0.1"), rounding="ROUND_HALF_UP")
    assert Decimal(str(out[7].AVG_C_AMT)) == want
    assert out[7].AVG_C_CNT == len(hot) / 3


def test_dedup_and_semi_join_on_hot_key(spark, skewed):
    pdf, df = skewed
    first = {r.k: r.o for r in prep.dedup_first(df, "k", ["o"]).collect()}
    assert first == pdf.groupby("k").o.min().to_dict()
    base = spark.createDataFrame([(7,), (8,), (150,)], "k long")
    got = sorted(r.k for r in feat.semi_join(base, df, "k").collect())
    assert got == sorted(k for k in (7, 8, 150) if k in set(pdf.k))


def test_quantiles_of_a_hot_group_full_of_ties(spark, skewed):
    """Nine tenths zeros: what reaches the ranking is a row per value and map task, not a row per row."""
    pdf, df = skewed
    rng = np.random.default_rng(3)
    values = np.where(rng.random(40_000) < 0.9, 0.0, rng.normal(size=40_000))
    rows = spark.createDataFrame(pd.DataFrame({"g": np.where(np.arange(40_000) % 3, 1, 0), "value": values})).repartition(16)
    got = {(r.g, r.p): r.q for r in st.exact_quantiles(rows, ["g"], "value").collect()}
    for g in (0, 1):
        own = values[np.where(np.arange(40_000) % 3, 1, 0) == g]
        for p in (0.25, 0.5, 0.75):
            assert math.isclose(got[g, p], float(np.quantile(own, p)), abs_tol=1e-12)
    found = st.exact_quantiles(rows, ["g"], "value")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    partial = plan.index("functions=[partial_count(1)]")
    assert "hashpartitioning(g" in plan[:partial]                 # counted on the map side, then dealt by group
    for p in (0.25, 0.5, 0.75):
        hot = pdf[pdf.k == 7].x.to_numpy()
        q = {r.p: r.q for r in st.exact_quantiles(df.where("k = 7").select("k", "x"), ["k"], "x").collect()}
        assert math.isclose(q[p], float(np.quantile(hot, p)), rel_tol=1e-12, abs_tol=1e-12)
