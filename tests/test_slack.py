"""Lloyd steps over rows with slack: the same centres as full passes, exactly, and fewer rows compared."""

import random

import pytest
from pyspark.sql import functions as F

from segmint.operators import model as mdl

COLUMNS = ["a", "b"]


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(3)
    rows = [(i, rng.gauss(c % 4 * 3.0, 1.0), rng.gauss(c // 4 * 3.0, 1.0)) for i in range(1500) for c in [rng.randrange(12)]]
    rows += [(2000 + i, 1.0, 1.0) for i in range(300)]  # ties
    return spark.createDataFrame(rows, "id long, a double, b double").repartition(4)


def steps(points, k, settled, max_iter=80):
    own, qs = mdl._points(points, COLUMNS, "id")
    own = own.persist()
    candidates = mdl._candidates(own, qs, 2 * k, 42)
    fits = [mdl._starting_centres(candidates, k, 42, n) for n in range(2)]
    out = mdl._lloyd(own, qs, fits, max_iter, 0.0, settled)
    own.unpersist()
    return out


@pytest.mark.parametrize("k", [1, 2, 12])
def test_same_centres_as_full_passes(points, k):
    full, all_rows = steps(points, k, -1.0)
    few, compared = steps(points, k, 0.2)
    assert few == full                              # every coordinate, exactly
    assert set(all_rows) <= {1800, 3600} and len(compared) == len(all_rows)
    if k == 12:
        early, late = compared[0], compared[-1]
        assert late < early / 10 and sum(compared) < 0.7 * sum(all_rows)


def test_slack_from_the_first_step(points):
    full, _ = steps(points, 5, -1.0, max_iter=12)
    assert steps(points, 5, 1e9, max_iter=12)[0] == full


def test_fit_reports_its_passes_and_leaves_no_files(spark, points, tmp_dir):
    import os

    from segmint.session import checkpoint_dir
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    fit = mdl.fit_kmeans(points, COLUMNS, 12, tol=0.0, key="id")
    assert fit.compared[0] == 3600 and fit.compared[-1] < 1000
    assert set(os.listdir(folder)) == before
    labels = mdl.label(fit, points, COLUMNS).groupBy("Cluster").agg(F.count("*")).count()
    assert labels == fit.k == 12
