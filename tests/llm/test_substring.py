"""Substring dedup against every window of every document."""

import hashlib
import random
import re

import numpy as np
import pytest

from segmint.llm.queries import op2_substring
from segmint.llm.substring import Automaton, anchors, merged, remove_repeats

WORDS = re.compile("[^\x20\x09-\x0d]+")


def plain(rows, span=13):
    first = {}
    tokens = [(i if i is not None else 1 << 63, WORDS.findall(t or "")) for i, t in rows]
    for i, w in tokens:
        for k in range(len(w) - span + 1):
            key = tuple(w[k:k + span])
            first[key] = min(first.get(key, 1 << 70), i)
    out = []
    for (i, w), (own, _) in zip(tokens, rows):
        gone = [False] * len(w)
        for k in range(len(w) - span + 1):
            if first[tuple(w[k:k + span])] < i:
                gone[k:k + span] = [True] * span
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((own, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(5)]
    out = []
    for i in range(120):
        w = []
        for _ in range(rng.randint(0, 4)):
            b, s = rng.choice(base), rng.randint(0, 50)
            w += b[s:s + rng.randint(1, 40)] + [rng.choice(words) for _ in range(rng.randint(0, 3))]
        out.append((rng.choice([i, i, i, None, 7]), rng.choice([" ", "\n", "  "]).join(w) if rng.random() > 0.05 else None))
    return out + out[:10] + [(900, "a " * 300), (901, "a " * 200), (902, "a " * 13), (903, "a " * 12), (904, ""), (905, "A " * 13), (906, "a\xa0 " * 13)]


@pytest.mark.parametrize("bounds", [{}, {"shard": 7, "lot": 3}])
def test_against_every_window(spark, bounds):
    docs = spark.createDataFrame([(i, t, 1, b"") for i, t in rows()], "doc_id long, text string, n_words int, kept binary").repartition(5)
    found = remove_repeats(docs, **bounds)
    got = found.collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == plain(rows())
    for r in got:
        assert r.n_removed == sum(e - s for s, e in zip(r.starts or [], r.ends or []))
        assert r.kept is None or hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted([tuple(r) for r in op2_substring(spark, sf).collect()], key=str) == plain(docs)


def test_empty_and_short(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, None)], "doc_id long, text string")
    assert all(r.n_removed == 0 for r in remove_repeats(docs).collect())
    assert remove_repeats(docs.limit(0)).collect() == []


def test_parts():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 50).astype(np.uint64)
    for n in (12, 13, 50):
        assert len(anchors(h[:n], 13, 6)) == max(0, n - 12)
    assert (anchors(h[5:30], 13, 6) == anchors(h, 13, 6)[5:18]).all()  # equal windows, equal anchors
    words = [bytes([97 + i % 5]) for i in range(30)]
    a = Automaton(words, [0, 20], [4, 22], 3, 0, 5)  # windows 0-3 and the first of the second run
    assert a.locate([b"x", b"a", b"b", b"c", b"x", *words[20:23]]) == [1, 5]
    assert [x.tolist() for x in merged(np.array([[5, 8], [0, 3], [7, 9], [1, 2]]))] == [[0, 5], [3, 9]]
