"""Hilbert curves and the search against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmint.llm.curves import _dealt, hilbert, nearest
from segmint.llm.queries import op5_nearest


@pytest.mark.parametrize("axes,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_in_unit_steps(axes, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    keys = hilbert(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def plain(rows, k=20, every=20):
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    return {i: sorted((-float((v * w).sum()), j) for j, w in good if j != i and len(w) == len(v))[:k] for i, v in good if i % every == 0}


def rows():
    rng = random.Random(1)
    out = [(i, [float(rng.randint(-1, 1)) for _ in range(3)]) for i in range(300)]
    out += [(i, [1.0, 1.0, 1.0]) for i in range(1000, 1300)]  # copies
    return out + [(401, None), (420, []), (402, [None, 1.0, 1.0]), (440, [float("nan"), 1.0, 0.0]), (460, [0.0, 0.0, 0.0]), (480, [float("inf"), 0.0, 1.0]), (500, [1.0, 2.0]),
                  (520, [5.0, 1.0]), (None, [1.0, 1.0, 1.0]), (540, [9.0])]


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_ties_copies_and_bad_rows_exactly(spark):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows()], "vec_id long, embedding array<float>, rank int").repartition(5)
    want = {i: v for i, v in plain(rows()).items() if v}
    assert lists(nearest(df, F.col("vec_id") % 20 == 0)) == want
    assert lists(nearest(df, F.col("vec_id") % 20 == 0, block=16)) == want  # windows over many blocks
    assert nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_recall_where_windows_are_a_small_part(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 6000)] + 0.25 * rng.normal(size=(6000, 16))) * rng.uniform(0.9, 1.1, size=(6000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = lists(nearest(df, F.col("vec_id") % 60 == 0, window_rows=150, block=512))
    s = x[::60] @ x.T
    s[np.arange(100), np.arange(0, 6000, 60)] = -np.inf
    kth = -np.sort(-s, axis=1)[:, 19]
    assert len(got) == 100
    assert np.mean([sum(-v >= kth[q // 60] - 1e-9 for v, _ in own) / 20 for q, own in got.items()]) >= 0.9


def test_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    x = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    e, ids = np.array(x.embedding.tolist(), dtype=float), x.vec_id.to_numpy()
    got = lists(op5_nearest(spark, sf))
    hit = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = e @ e[i]
        s[i] = -np.inf
        kth = np.sort(s)[-20]
        own = got[ids[i]]
        assert len(own) == 20 and np.allclose([-v for v, _ in own], [s[np.flatnonzero(ids == j)[0]] for _, j in own])
        hit, total = hit + sum(-v >= kth - 1e-12 for v, _ in own), total + 20
    assert hit / total >= 0.9


def recall(spark, x, asked):
    """Mean share of the true 20 nearest that the search finds for the rows ``asked`` (ids are places), and the least one."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = lists(nearest(df, F.col("vec_id").isin([int(i) for i in asked])))
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    kth = -np.sort(-s, axis=1)[:, 19]
    each = [sum(-v >= k - 1e-12 * abs(k) for v, _ in got[int(i)]) / 20 for i, k in zip(asked, kth)]
    return np.mean(each), min(each)


def unit(rng, n, dims=64):
    x = rng.normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("sigma", [0.3, 0.6, 1.0])
def test_recall_where_lengths_differ(spark, sigma):
    rng = np.random.default_rng(6)
    x = unit(rng, 10_000) * rng.lognormal(0, sigma, size=(10_000, 1))
    found = recall(spark, x, np.arange(0, 10_000, 50))
    print("recall", sigma, found)
    assert found[0] >= 0.9


def test_recall_with_one_very_long_row(spark):
    rng = np.random.default_rng(7)
    x = unit(rng, 10_000)
    x[77] *= 1000.0
    found = recall(spark, x, np.arange(0, 10_000, 50))
    print("recall outlier", found)
    assert found[0] >= 0.9 and found[1] >= 0.5


def test_lengths_at_the_ends_of_what_a_double_holds(spark):
    rows = [(i, [float(1 + i % 3), float(i % 7), 1.0], e) for i, e in enumerate([1e-300, 1.0, 1e150] * 20)]
    rows = [(i, [c * e for c in v]) for i, v, e in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert lists(nearest(df, F.col("vec_id") % 20 == 0)) == plain(rows)


@pytest.mark.parametrize("spread", [1e-3, 1e-4, 1e-5])
def test_recall_within_a_tight_group(spark, spread):
    """A third of all rows is one vector with jitter; queries from the group."""
    rng = np.random.default_rng(8)
    x = unit(rng, 9_000)
    group = x[1] + spread * unit(rng, 3_000)
    x[:9_000:3] = group / np.linalg.norm(group, axis=1)[:, None]
    found = recall(spark, x, np.arange(0, 9_000, 45))
    print("recall group", spread, found)
    assert found[0] >= 0.9


def test_recall_within_a_tight_group_of_other_lengths(spark):
    rng = np.random.default_rng(9)
    x = unit(rng, 9_000) * rng.uniform(0.8, 1.25, size=(9_000, 1))
    x[:9_000:3] = 0.9 * x[1] / np.linalg.norm(x[1]) + 1e-4 * unit(rng, 3_000)
    found = recall(spark, x, np.arange(0, 9_000, 45))
    print("recall group lengths", found)
    assert found[0] >= 0.9


def test_queries_of_a_block_come_in_bounded_lots(spark):
    rows = spark.range(100).selectExpr("1 AS dim", "0 AS band", "0 AS t", "id div 50 AS block", "id AS rank", "id AS rep")
    queries = spark.range(4_000).selectExpr("1 AS d", "0 AS of", "0 AS o", "0L AS b", "id AS query")
    own, asked = _dealt(rows, queries, 250)
    sizes = {r["l"]: r["count"] for r in asked.groupBy("l").count().collect()}
    assert len(sizes) == 16 and sum(sizes.values()) == 4_000 and max(sizes.values()) <= 2 * 250
    assert {(r["block"], r["lot"]): r["count"] for r in own.groupBy("block", "lot").count().collect()} == {(0, k): 50 for k in range(16)}


def test_lots_change_nothing(spark):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit(np.random.default_rng(10), 1_000, 8))], "vec_id long, embedding array<double>")
    asked = F.col("vec_id") % 4 == 0
    assert lists(nearest(df, asked, window_rows=60, block=100, lot=9)) == lists(nearest(df, asked, window_rows=60, block=100))
