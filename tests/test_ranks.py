"""Quantiles by rank: narrowing passes bound what one task ranks, at every distribution of values."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from segmint.operators import stats as st

PROBS = (0.0, 0.25, 0.5, 0.75, 0.999, 1.0)


def values(kind, n=6000):
    rng = random.Random(kind)
    if kind == "even":
        return [rng.uniform(-5, 5) for _ in range(n)]
    if kind == "steep":
        return [10.0 ** rng.uniform(-300, 300) for _ in range(n)]
    if kind == "two clumps":
        return [rng.choice([-1e12, 1e12]) + rng.random() for _ in range(n)]
    if kind == "ties":
        return [float(rng.choice([1, 1, 1, 1, 2, 3, 1e9])) for _ in range(n)]
    if kind == "ends":
        return [rng.choice([-1.7e308, 1.7e308, 0.0, rng.gauss(0, 1)]) for _ in range(n)]
    return [7.25] * n


@pytest.mark.parametrize("kind", ["even", "steep", "two clumps", "ties", "ends", "one value"])
def test_one_large_group(spark, monkeypatch, kind):
    own = values(kind)
    rows = [("big", v) for v in own] + [(None, float(i)) for i in range(40)] + [("none", None)] * 3
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    monkeypatch.setattr(st, "RANKED", 20)
    brackets = st._narrow(df, ["g"], ["v"], PROBS, st._moments(df, ["g"], ["v"], PROBS))
    inside = st._cells(df, ["g"], ["v"], PROBS, brackets).where("v >= lo").groupBy("g", "j").agg(F.count_distinct("v").alias("n")).collect()
    assert max(r.n for r in inside) <= 20                     # what one task ranks
    got = {(r.g, r.p): r.q for r in st.exact_quantiles(df, ["g"], "v", PROBS).collect()}
    for g, vs in (("big", own), (None, [float(i) for i in range(40)])):
        for p in PROBS:
            s = sorted(vs)
            h = p * (len(s) - 1)
            a, b = s[int(h)], s[min(int(h) + 1, len(s) - 1)]
            assert got[g, p] == a + (b - a) * (h - int(h)), (g, p)


def test_describe_is_the_same_with_and_without(spark, monkeypatch):
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.choice([0, 0, 0, 1, 2]), rng.gauss(0, 1), float(rng.randint(0, 9)), None if i % 3 else 1.5) for i in range(5000)], "c int, a double, b double, d double")
    want = sorted(map(tuple, st.describe_by(df, "c", ["a", "b", "d"]).collect()), key=str)
    monkeypatch.setattr(st, "RANKED", 5)
    assert sorted(map(tuple, st.describe_by(df, "c", ["a", "b", "d"]).collect()), key=str) == want
    pdf = df.toPandas().groupby("c")["a"].describe()
    by = {(r[0], r[1]): r for r in want}
    for c in pdf.index:
        assert pd.Series(by["a", c][6:9]).tolist() == pytest.approx(pdf.loc[c, ["25%", "50%", "75%"]].tolist(), rel=1e-14)
