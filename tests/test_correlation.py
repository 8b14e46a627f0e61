"""Correlation of many columns with random nulls against brute force; far values, NaN, constants, empty tables."""

import math

import numpy as np

from segmint.operators import stats as st


def plain(x, here):
    """r of every pair about the pair's own means."""
    n = x.shape[1]
    out = {}
    for i in range(n):
        for j in range(i + 1):
            own = here[:, i] & here[:, j]
            a, b = x[own, i], x[own, j]
            if not len(a) or a.min() == a.max() or b.min() == b.max():
                out[i, j] = None
                continue
            a, b = a - math.fsum(a) / len(a), b - math.fsum(b) / len(b)
            out[i, j] = math.fsum(a * b) / math.sqrt(math.fsum(a * a)) / math.sqrt(math.fsum(b * b))
    return out


def test_112_columns_with_random_nulls(spark):
    rng = np.random.default_rng(2)
    n, rows = 112, 700
    base = rng.normal(size=(rows, 8))
    x = base @ rng.normal(size=(8, n)) + rng.normal(size=(rows, n)) + 10.0 ** rng.integers(-3, 9, size=n)
    x[:, 5], x[:, 6] = 3.1, np.where(np.arange(rows) % 2 == 0, 0.1, 7.0)
    here = rng.random((rows, n)) > 0.1
    here[:, 7] = False                                  # never present
    here[:, 6] &= np.arange(rows) % 2 == 0              # constant where present
    here[:, 9] &= ~here[:, 10]                          # no row has both
    x[~here[:, 12], 11] = -1e12                         # far away wherever column 12 is missing
    cols = [f"c{i}" for i in range(n)]
    data = [tuple(float(v) if h else None for v, h in zip(r, p)) for r, p in zip(x, here)]
    df = spark.createDataFrame(data, ", ".join(f"{c} double" for c in cols)).repartition(3)
    want = plain(x, here)
    got = {(int(r.var_x[1:]), int(r.var_y[1:])): r.r for r in st.correlation_long(df, cols, lower_only=True, digits=None).collect()}
    assert got.keys() == want.keys() and len(want) == 112 * 113 // 2
    for pair, r in want.items():
        assert (got[pair] is None) == (r is None), pair
        if r is not None:
            size = max(np.abs(x[here[:, c], c]).max() / x[here[:, c], c].std() for c in pair)
            assert abs(got[pair] - r) < 1e-12 + 1e-15 * size * size ** 0.5, pair
    assert got[12, 11] is not None and abs(got[12, 11] - want[12, 11]) < 1e-9


def test_nan_infinite_and_empty(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, float("nan"), 2.0), (3.0, 1.0, float("inf")), (4.0, 0.5, None)], "a double, b double, c double")
    got = {(r.var_x, r.var_y): r.r for r in st.correlation_long(df, ["a", "b", "c"]).collect()}
    assert got[("a", "a")] == 1.0 and all(got[p] is None for p in (("a", "b"), ("b", "c"), ("c", "a"), ("c", "c")))
    none = st.correlation_long(df.limit(0), ["a", "b"], lower_only=True).collect()
    assert sorted((r.var_x, r.var_y, r.r) for r in none) == [("a", "a", None), ("b", "a", None), ("b", "b", None)]


def test_one_group_by_and_no_patterns(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None)], "a double, b double")
    plan = st.correlation_long(df, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "mask" not in plan
