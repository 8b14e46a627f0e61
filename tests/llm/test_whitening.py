"""Whitening: rank-one updates and merges against dense eigenproblems, the query against exact sums, defined edge cases."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from segmint.llm.whitening import Spectrum, Whitening, rank_one, secular_roots, whiten


def close(values, vectors, dense):
    size = max(np.abs(dense).max(), 1e-300)
    assert np.all(np.diff(values) >= 0)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
    assert np.abs(vectors @ np.diag(values) @ vectors.T - dense).max() < 1e-13 * size * len(values)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.0, 1.0, 1.0 + 1e-15, 1.0 + 1e-9, 2.0, 1e-12, 1e9, 7.5]), min_size=1, max_size=12), st.data())
def test_rank_one_against_dense(values, data):
    d = len(values)
    u = np.array(data.draw(st.lists(st.sampled_from([0.0, 1.0, -1.0, 1e-18, 1e-8, 3.25, -40.0]), min_size=d, max_size=d)))
    rho = data.draw(st.sampled_from([1e-6, 0.5, 1.0, 1e6]))
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    values = np.sort(np.array(values))
    got, vectors = rank_one(values, q, rho, q @ u)
    close(got, vectors, q @ (np.diag(values) + rho * np.outer(u, u)) @ q.T)


def test_roots_between_the_poles():
    poles = np.array([0.0, 1.0, 1.0 + 1e-10, 5.0, 1e6])
    weights = np.array([1e-20, 1.0, 1e-3, 1e-14, 100.0])
    roots, gaps = secular_roots(poles, weights)
    assert np.all(roots >= poles) and np.all(roots[:-1] <= poles[1:])
    # every root balances the terms: relative to their size, the sum vanishes
    terms = weights[:, None] / gaps
    assert np.abs(1 + terms.sum(axis=0)).max() < 1e-9 * np.abs(terms).sum(axis=0).max()


@pytest.mark.parametrize("d,n", [(1, 5), (3, 2), (6, 200), (64, 150)])
def test_rows_and_merges(d, n):
    rng = np.random.default_rng(d + n)
    x = np.round(rng.normal(size=(n, d)) * 300) + 1000.0
    x[n // 2:n // 2 + 3] = x[0]  # repeated rows
    parts = []
    for k in range(0, n, 70):
        s = Spectrum.empty(d)
        for row in x[k:k + 70]:
            s.add(row)
        parts.append(s)
    total = Spectrum.empty(d)
    for s in [*parts, Spectrum.empty(d)]:
        total.merge(s)
    centred = x - x.mean(axis=0)
    assert total.n == n and np.allclose(total.mean, x.mean(axis=0), rtol=1e-13)
    dense = centred.T @ centred
    assert np.abs(total.vectors @ np.diag(total.values) @ total.vectors.T - dense).max() <= 1e-11 * np.abs(dense).max()
    assert np.abs(total.vectors.T @ total.vectors - np.eye(d)).max() < 1e-11


def plain(rows, k=8):
    """Exact sums in whole numbers, the covariance's eigenvectors by a dense solver."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(r, sums)] for r in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return n, deviation, centred @ vectors / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def check(got, rows, k):
    n, deviation, white, explained = plain(rows, k)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    signs = None
    for (i, _), dev, w in zip(rows, deviation, white):
        mine = sorted(by[i], key=lambda r: r.component)
        assert [r.component for r in mine] == list(range(1, k + 1)) and {r.n for r in mine} == {n} and {r.deviation for r in mine} == {dev}
        y = np.array([r.whitened for r in mine])
        signs = np.sign(y * w) if signs is None else signs
        assert np.abs(y - signs * w).max() < 1e-9
        assert np.allclose([r.explained for r in mine], explained, rtol=1e-10)
        assert all(r.identity_error < 1e-10 for r in mine)
    assert len(got) == n * k


def test_query_against_dense(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=20) * np.linspace(0.05, 0.6, 20) + 0.3).tolist()) for i in range(400)]
    odd = [(900, None), (901, []), (902, [None] * 20), (903, [float("nan")] + [0.0] * 19), (904, [float("inf")] * 20), (905, [1.0] * 3), (906, [1e300] * 20)]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, n int, component string").repartition(37)
    check(whiten(table).collect(), rows, 8)


def test_fewer_directions_than_components(spark):
    rows = [(i, [i * 0.5, i * 1.0, 7.0, (i % 2) * 3.0]) for i in range(30)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    check(whiten(table).collect(), rows, 2)


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, [0.0, 1.0])] * 3 + [(1, [2.0, 5.0])] * 2 + [(2, [-3.0, 0.5])]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == 12 and sum(r.vec_id is None for r in got) == 6 and {r.n for r in got} == {6}


def test_without_variance_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    assert whiten(spark.createDataFrame([], schema)).collect() == []
    assert whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []


def test_deviations_beyond_long():
    model = Whitening(1, 0, 3, (2**50, 0), np.eye(2), np.ones(2), 2.0)
    assert model.deviations(np.array([[2**50, 5], [1, 2]])) == [None, None]
    model = Whitening(1, 0, 10**12, (5 * 10**12, 10**12), np.eye(2), np.ones(2), 2.0)
    assert model.deviations(np.array([[5, 1], [5, 2], [7, 1]])) == [0, None, None]
    model = Whitening(1, 0, 10**9, (5 * 10**9, 10**9), np.eye(2), np.ones(2), 2.0)
    assert model.deviations(np.array([[5, 1], [5, 2], [7, 2]])) == [0, 10**18, 5 * 10**18]
