"""Periodic runs: extensions letter by letter, runs of every period by brute force, planted runs, defined edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from segmint.llm.runs import Grammar, find_runs, periodic_runs, planted, runs_digest

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_runs(w, least=12):
    """Every stretch of agreement with the place q further on, smallest periods first."""
    found, n = {}, len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    drop = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def one(w):
    sequence = np.array([99, *w, 100])
    return [(s - 1, e - s, q) for s, e, q in find_runs(sequence, np.array([1]), np.array([len(w)]), 99, 12).tolist()]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 9)), max_size=8))
def test_runs_by_brute_force(parts):
    w = [x for part, times in parts for x in part * times]
    assert sorted(one(w)) == sorted(plain_runs(w))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=2, max_size=120), st.data())
def test_extensions_letter_by_letter(w, data):
    sequence = np.array([50, *w, 51])
    g = Grammar(sequence, 50)
    pairs = [(x, y) for x in range(1, len(w) + 1) for y in range(x + 1, len(w) + 1)]
    x, y = map(np.array, zip(*pairs))
    ahead, behind = g.agree(x, y), g.agree(x, y, back=True)
    for a, b, f, r in zip(x.tolist(), y.tolist(), ahead.tolist(), behind.tolist()):
        want = 0
        while sequence[a + want] == sequence[b + want]:
            want += 1
        assert f == want
        want = 0
        while sequence[a - want] == sequence[b - want]:
            want += 1
        assert r == want


def test_long_sequences():
    rng = np.random.default_rng(1)
    fibonacci = [[0], [1]]
    while len(fibonacci[-1]) < 600:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for w in (fibonacci[-1], [0] * 700, [0, 1] * 350, rng.integers(0, 50, 800).tolist(), rng.integers(0, 2, 500).tolist(), ([1, 2, 3, 1, 2] * 30 + [4]) * 4):
        assert sorted(one(w)) == sorted(plain_runs(w))
    assert Grammar(np.array([9, *[0, 1] * 50_000, 10]), 9).symbols[-1].size == 3  # one symbol between the separators
    assert one([7] * 100_000) == [(0, 100_000, 1)]


def texts():
    rng = random.Random(4)
    out = [None, "", " \n\t ", "a", "a " * 11, "a " * 12, "a b " * 6, "a b " * 5 + "a", "x" + "\x0b\x0c\r\n".join("y" * 20) + "z", "a\xa0b " * 20, "é ü " * 9]
    for _ in range(120):
        out.append(" ".join(rng.choice("ab cd ef gh".split()) for _ in range(rng.randint(0, 90))))
        part = " ".join(rng.choices("abcdefgh", k=rng.randint(1, 20)))
        out.append(f"start of it {' '.join([part] * rng.randint(1, 6))} and the end")
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "p") for i, t in enumerate(texts())] + [(7, "a b c " * 8, 0, ""), (7, "a b c " * 8, 0, ""), (None, "q r " * 30, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, period int, runs string").repartition(3)


def test_query_by_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = runs_digest(periodic_runs(docs.withColumn("text", planted(F.col("doc_id"), F.col("text")))))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([plain(i, t) for i, t in rows], key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 10


def test_long_text_in_its_own_lot(spark):
    long = " ".join(f"w{i % 70_001}" for i in range(250_000))
    docs = spark.createDataFrame([(1, "a b " * 8), (2, long), (3, None)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in periodic_runs(docs).collect()}
    assert [tuple(r) for r in got[2].runs] == [(0, 250_000, 70_001)] and got[2].n_words == 250_000
    assert bytes(got[2].collapsed).decode().split() == long.split()[:70_001]
    assert [tuple(r) for r in got[1].runs] == [(0, 16, 2)] and bytes(got[1].collapsed) == b"a b" and got[3].runs == []


def test_shortest_run(spark):
    docs = spark.createDataFrame([(1, "a a b b b"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: [tuple(x) for x in r.runs] for r in periodic_runs(docs, least=2).collect()} == {1: [(0, 2, 1), (2, 3, 1)], 2: []}
    with pytest.raises(ValueError):
        periodic_runs(docs, least=1)


def test_empty(spark):
    assert runs_digest(periodic_runs(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
