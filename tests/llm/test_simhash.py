"""SimHash near-dedup against all pairs."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from segmint.llm import simhash
from segmint.llm.graph import components
from segmint.llm.simhash import fingerprint, forest, keep_one, links, list_edges, near_duplicates, position_groups

WORDS = re.compile("[^\x20\x09-\x0d]+")


def plain_fingerprint(text, n=4, seed=42):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + n]).encode(), seed) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(nodes, linked):
    top = {n: n for n in nodes}

    def find(n):
        while top[n] != n:
            n = top[n]
        return n
    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            a, b = sorted((find(a), find(b)))
            top[b] = a
    return {n: find(n) for n in nodes}


def planted(seed=3):
    rng = random.Random(seed)
    found = {rng.getrandbits(64) for _ in range(300)}
    for base in sorted(found)[:25]:
        now = base
        for _ in range(rng.randint(1, 14)):
            now = base if rng.random() < 0.3 else now
            for b in rng.sample(range(64), rng.randint(1, 6)):
                now ^= 1 << b
            found.add(now)
    centre = rng.getrandbits(64)
    for _ in range(150):
        found.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    return [int(x) for x in np.array(sorted(found), dtype=np.uint64).view(np.int64)]


def grouped(roots):
    groups = {}
    for n, r in roots.items():
        groups.setdefault(r, set()).add(n)
    return sorted(sorted(g) for g in groups.values() if len(g) > 1)


def near(d):
    return lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= d


@pytest.mark.parametrize("d", range(1, 8))
def test_position_groups_meet_every_pair(d):
    groups = position_groups(8 - d, min(max(1, 7 - d), 4))
    assert all(any(set(g) <= set(m) for g in groups) for m in itertools.combinations(range(8), 8 - d))


def test_twenty_sets_for_four_bits():
    assert len(position_groups(4, 3)) == 20


@pytest.mark.parametrize("d,most", [(4, 1 << 20), (4, 20), (3, 20), (3, 1 << 20), (6, 1 << 20)])
def test_links_join_what_all_pairs_join(spark, d, most):
    x = planted()
    found = components(links(spark.createDataFrame([(v,) for v in x], "fp long"), d, most)).collect()
    assert grouped({r.node: r.root for r in found}) == grouped(plain_components(x, near(d)))


def test_forest_and_split_lists(monkeypatch):
    x = np.array(planted(4), dtype=np.int64).view(np.uint64)
    edges = [(int(x[a]), int(x[b])) for a, b in forest(x, 4)]
    assert all(near(4)(a, b) for a, b in edges) and len(edges) < len(x)
    want = grouped(plain_components([int(v) for v in x], near(4)))
    assert grouped(plain_components([int(v) for v in x], lambda a, b: (a, b) in set(edges) or (b, a) in set(edges))) == want
    # A list that is cut by one more position finds all that share its three bytes and a fourth.
    base = int(x[0]) & 0xFFFFFF
    rng = random.Random(1)
    own = sorted({base | (rng.getrandbits(40) << 24) for _ in range(200)} | {base | (i << 24) for i in range(60)})
    monkeypatch.setattr(simhash, "SPLIT", 20)
    found = list_edges(np.zeros(len(own), dtype=np.int64), np.array(own, dtype=np.uint64), [(0, 1, 2)], 4)
    pairs = {(int(a), int(b)) for a, b in np.concatenate(found)}
    assert grouped(plain_components(own, lambda a, b: (a, b) in pairs or (b, a) in pairs)) == grouped(plain_components(own, near(4)))


def test_fingerprints():
    rng = random.Random(6)
    texts = ["", " \n\t", "One", "a b c", "A b C d", "ÀÉ x\xa0y  z w q"] + [" ".join(rng.choices(["The", "cat", "é", "sat.", "ON"], k=rng.randint(1, 60))) for _ in range(60)]
    assert all(fingerprint(t.encode(), 4, 42) == plain_fingerprint(t) for t in texts)


def rows():
    rng = random.Random(8)
    out = []
    for g in range(12):
        words = [f"w{rng.randint(0, 500)}" for _ in range(150)]
        for c in range(rng.randint(1, 4)):
            own = list(words)
            if c:
                own[rng.randrange(150)] = "changed"
            out.append((rng.randint(0, 10_000), " ".join(own)))
    return [*out, (1, None), (2, ""), (3, "  "), (None, out[0][1]), (None, "only without an id"), (7, "twice"), (7, "twice"), (7, "another text")]


def test_documents_against_all_pairs(spark):
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in rows()], "doc_id long, text string, component_id string, root int").repartition(4)
    found = near_duplicates(docs)
    got = sorted([(r.doc_id, r.fp, r.component_id) for r in found.collect()], key=str)
    fps = [int(np.uint64(plain_fingerprint(t or "")).astype(np.int64)) for _, t in rows()]
    roots = plain_components(sorted(set(fps)), near(4))
    first = {}
    for (i, _), f in zip(rows(), fps):
        first[roots[f]] = min((x for x in (i, first.get(roots[f])) if x is not None), default=None)
    assert got == sorted([(i, f, first[roots[f]]) for (i, _), f in zip(rows(), fps)], key=str)
    kept = keep_one(docs, found)
    assert kept.columns == docs.columns
    left = kept.collect()
    assert len(left) == len(set(roots.values()))
    assert {(r.doc_id) for r in left} == set(first.values())


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).collect() == []
