"""Nearest centres and the sums of a pass: taken a batch at a time in the tasks, with the results of a row by row loop."""

import math
import random

import pytest

from segmint.operators import model as mdl

NAN, INF = float("nan"), float("inf")


def plan(df):
    return df._jdf.queryExecution().toString()


def row_by_row(x, centres):
    """(d, c) of one point: squares added in the order of the coordinates, ties to the lower index, NaN last."""
    found = []
    for i, c in enumerate(centres):
        d = 0.0
        for u, v in zip(x, c):
            d = d + (u - v) * (u - v)
        found.append((math.isnan(d), d if not math.isnan(d) else 0.0, i))
    bad, d, i = min(found)
    return NAN if bad else d, i


def test_every_distance_is_taken_in_batches(spark):
    """No lambda over the centres, which Spark would interpret anew for every row, centre and variable."""
    rng = random.Random(5)
    cols = [f"v {i}`" for i in range(21)]
    rows = [tuple(rng.gauss(0, 1) for _ in cols) for _ in range(3000)]
    rows += [rows[0][:20] + (None,), rows[1][:20] + (NAN,), rows[2][:20] + (INF,), rows[3][:20] + (-INF,)]
    centres = [[rng.gauss(0, 1) for _ in cols] for _ in range(29)]
    centres.append(list(centres[7]))  # a tie
    df = spark.createDataFrame(rows).toDF(*cols).repartition(2)
    out = mdl.assign_nearest(df, cols, centres, "Cluster", distance="d")
    assert "MapInArrow" in plan(out) and "lambda" not in plan(out)
    assert dict(out.dtypes)["Cluster"] == "int" and dict(out.dtypes)["d"] == "double"
    seen = out.collect()
    assert len(seen) == len(rows)
    for r in seen:
        x = tuple(r)[:21]
        want = (None, None) if None in x else row_by_row(x, centres)
        got = (r.d, r.Cluster)
        assert got == want or (math.isnan(want[0]) and math.isnan(got[0]) and got[1] == want[1])


@pytest.mark.parametrize("scale", [1.0, 1e10])  # sums within and beyond what a double holds exactly
def test_a_pass_expands_no_row_and_sums_exactly(spark, monkeypatch, scale):
    rng = random.Random(6)
    rows = [(float(round(rng.gauss(0, 1e5) * scale)), float(round(rng.gauss(0, 1e5)))) for _ in range(5000)]
    fits = [[list(map(float, rows[i])) for i in range(k)] for k in (1, 3, 10)]
    plans, added = [], mdl._added
    monkeypatch.setattr(mdl, "_added", lambda partial, *own: plans.append(plan(partial)) or added(partial, *own))
    points = spark.createDataFrame(rows, "__q0 double, __q1 double").repartition(3)
    got = {(r["fit"], r["c"]): (r["__q0"], r["__q1"], r["n"]) for r in mdl._label_sums(points, ["__q0", "__q1"], fits)}
    want: dict = {}
    for f, centres in enumerate(fits):
        for x in rows:
            at = (f, row_by_row(x, centres)[1])
            a, b, n = want.get(at, (0, 0, 0))
            want[at] = (a + int(x[0]), b + int(x[1]), n + 1)
    assert got == want
    assert plans and "Generate" not in plans[0] and "lambda" not in plans[0]


def test_the_second_nearest(spark):
    compare = mdl._comparer([[[0.0], [10.0], [10.0]], [[5.0]]])
    import numpy as np
    d, c, second = compare(0, [np.array([1.0, 9.0, 10.0])], second=True)
    assert d.tolist() == [1.0, 1.0, 0.0] and c.tolist() == [0, 1, 1] and second.tolist() == [81.0, 1.0, 0.0]
    assert compare(1, [np.array([1.0])], second=True)[2].tolist() == [INF]
    assert [len(x) for x in compare(0, [np.array([])], second=True)] == [0, 0, 0]
