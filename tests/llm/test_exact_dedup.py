"""Exact dedup: composable fingerprints, splits of equal fingerprints, defined edge cases."""

import hashlib
import random
import re

import pytest

from segmint.llm.exact_dedup import Hasher, exact_dedup, keep_one

BLANK = re.compile("[\x20\x09-\x0d]")
#: Fingerprints of a few values only, so that different texts share them all the time.
WEAK = ((11, 3), (7, 2))


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(BLANK.sub("", t or ""), []).append((-len(t or ""), i is None, i if i is not None else 0))
    out = []
    for i, t in rows:
        n = BLANK.sub("", t or "")
        best = min(groups[n])
        out.append((i, None if best[1] else best[2], len(groups[n]), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def rows():
    rng = random.Random(2)
    out = [(i, "".join(rng.choices("ab é\n\t", k=rng.randint(0, 5)))) for i in range(120)]
    return out + [(200, None), (201, ""), (None, " x y "), (None, "xy"), (202, "xy"), (203, "x\xa0y"), (5, "again"), (5, "again"), (6, "z" * 300_000), (7, "z" * 299_999 + "y"), (8, "z" * 300_000 + " ")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "c") for i, t in rows()], "doc_id long, text string, fp int, chunk string").repartition(5)


@pytest.mark.parametrize("primes", [None, WEAK])
def test_against_plain_version(docs, primes):
    found = (exact_dedup(docs, primes) if primes else exact_dedup(docs)).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found], key=str) == plain(rows())
    by_text = {}
    for r in found:
        by_text.setdefault(r.text_sha256, []).append(r)
    assert all(sum(r.kept for r in g) == 1 and all(r.doc_id == r.keep_id for r in g if r.kept) for g in by_text.values())


def test_rows_without_an_own_id_and_different_texts(spark):
    """Different texts of one fingerprint under null and repeated ids (the primes are weak, so that all share one)."""
    rows = [(None, "ab"), (None, "cd"), (5, "ab"), (5, "cd"), (1, "ab"), (2, "cd"), (None, "ef"), (5, "ef")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = exact_dedup(docs, ((2, 1),))
    got = sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found.collect()], key=str)
    want = []
    for i, t in rows:
        ids = [j for j, u in rows if u == t and j is not None]
        want.append((i, min(ids), sum(u == t for _, u in rows), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want, key=str) and len({r.text_sha256 for r in found.collect()}) == 3
    assert sorted(r.text for r in keep_one(docs, found).collect()) == ["ab", "cd", "ef"]


def test_keep_one_keeps_all_columns_and_each_text_once(docs):
    kept = keep_one(docs, exact_dedup(docs))
    got = kept.collect()
    assert kept.columns == docs.columns
    assert sorted(BLANK.sub("", r.text or "") for r in got) == sorted({BLANK.sub("", t or "") for _, t in rows()})


def test_fingerprints_compose():
    rng = random.Random(1)
    data = rng.randbytes(5000)
    h = Hasher(chunk=64)
    for k in (0, 1, 63, 64, 65, 4999, 5000):
        a, b = h.of(data[:k]), h.of(data[k:])
        assert (a + b).key() == h.of(data).key() and (a + b).length == 5000
    for (p, base), got in zip(h.primes, h.of(data).hashes):
        assert got == sum(c * pow(base, 4999 - i, p) for i, c in enumerate(data)) % p


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup(docs).collect() == [] and keep_one(docs, exact_dedup(docs)).collect() == []
