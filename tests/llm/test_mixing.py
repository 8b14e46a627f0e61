"""Mixing: budgets against a plain version, native plans, whole epochs before a prefix."""

import hashlib
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from segmint.llm import mixing
from segmint.llm.mixing import leaf_budgets, mix, take

LEVELS = ["a", "b"]
WORDS = re.compile("[^\x20\x09-\x0d]+")


def plain_budgets(avail, weights, budget, epochs):
    """Water filling by hand: the fullest child first, then shares of the rest."""
    out = {}

    def give(path, amount, depth):
        if depth == 2:
            out[path] = amount
            return
        kids = sorted({k[:depth + 1] for k in avail if k[:depth] == path})
        limit = {k: epochs * sum(v for p, v in avail.items() if p[:depth + 1] == k) for k in kids}
        weight = {k: weights.get(k, 1) for k in kids}
        kids = [k for k in kids if weight[k] > 0 and limit[k] > 0]
        rest, open_ = amount, list(kids)
        full = {}
        while open_:
            total = sum(weight[k] for k in open_)
            now = [k for k in open_ if Fraction(limit[k], weight[k]) <= Fraction(rest, total)]
            if not now:
                break
            k = min(now, key=lambda k: (Fraction(limit[k], weight[k]), k[-1]))
            full[k] = limit[k]
            rest -= limit[k]
            open_.remove(k)
        for k in kids:
            give(k, full[k] if k in full else rest * weight[k] // sum(weight[x] for x in open_), depth + 1)
    give((), budget, 0)
    return out


def test_budgets_against_plain_version(spark):
    rng = random.Random(7)
    for case in range(4):
        avail = {(x, y): rng.choice([0, 1, 3, 50, 1000, 10**13]) for x in "pqr" for y in "123" if rng.random() < 0.8}
        weights = {(x,): rng.randint(0, 4) for x in "pq"} | {(x, y): rng.randint(1, 5) for x in "pr" for y in "12"}
        budget = rng.choice([0, 17, sum(avail.values()) // 2, sum(avail.values()) * 3])
        leaves = spark.createDataFrame([(*k, v) for k, v in avail.items()], "a string, b string, available long")
        got = {(r.a, r.b): int(r.budget) for r in leaf_budgets(leaves, LEVELS, weights, budget, 2).collect()}
        want = plain_budgets(avail, weights, budget, 2)
        assert got == want, case
        assert sum(got.values()) <= budget


def rows():
    rng = random.Random(3)
    out = [(i, " ".join(["w"] * rng.randint(0, 9)), rng.choice(["x", "x", "x", "y", None]), rng.choice(["1", "2", None]), i) for i in range(300)]
    return out + [(5, "a b c", "x", "1", 0), (5, "a b c", "x", "1", 0), (None, "n n", "x", "1", 0), (400, None, "x", "1", 0), (401, "", "y", "2", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string, n_tokens string, place string, epoch int").withColumnRenamed("n_tokens", "domain").repartition(6)


def levels():
    return {"a": F.col("domain"), "b": F.col("place")}


WEIGHTS = {("y",): 6, ("x", "2"): 3}


def plain_mix(share, epochs, seed):
    leaf = {}
    for i, t, a, b, _ in rows():
        leaf.setdefault((a or "", b or ""), []).append((i, len(WORDS.findall(t or ""))))
    avail = {k: sum(n for _, n in v) for k, v in leaf.items()}
    given = plain_budgets(avail, WEIGHTS, sum(avail.values()) * share[0] // share[1], epochs)
    out = []
    for k, budget in given.items():
        full, rest = divmod(budget, avail[k])
        order = lambda r: (hashlib.md5(f"{seed}|{full + 1}|{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, r[1])  # noqa: B023, E731
        run = 0
        for i, n in sorted(leaf[k], key=order):
            run += n
            out += [(i, *k, n, e) for e in range(1, full + 1 + (run <= rest))]
    return sorted(out, key=str)


@pytest.mark.parametrize("share,epochs,ranges", [((4, 5), 2, 50_000), ((4, 5), 2, 10), ((3, 2), 3, 50_000)])
def test_mix_against_plain_version(docs, monkeypatch, share, epochs, ranges):
    monkeypatch.setattr(mixing, "RANGE_ROWS", ranges)
    got = mix(docs, levels(), WEIGHTS, share, epochs, seed=17).collect()
    want = plain_mix(share, epochs, 17)
    assert sorted([tuple(r) for r in got], key=str) == want
    taken = take(docs, levels(), WEIGHTS, share, epochs, seed=17)
    assert taken.columns == docs.columns
    count = lambda xs: {x: xs.count(x) for x in set(xs)}
    assert count([(r.doc_id, r.domain or "", r.place or "") for r in taken.collect()]) == count([x[:3] for x in want])


def test_native_and_empty(docs):
    plan = mix(docs, levels(), WEIGHTS)._jdf.queryExecution().executedPlan().toString()
    assert not any(n in plan for n in ("Python", "Arrow", "Pandas"))
    assert mix(docs.limit(0), levels(), WEIGHTS).collect() == [] and take(docs.limit(0), levels(), WEIGHTS).collect() == []
