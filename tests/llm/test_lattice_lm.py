"""Lattice likelihood: recursions against listed segmentations, base score by hand, held-out likelihood."""

import collections
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from segmint.llm.bpe import read_ranks
from segmint.llm.lattice_lm import Vocabulary, _weights, by_length, expected, forward, score_documents

PIECES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = re.compile("[^\x20\x09-\x0d]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def ways(word, pieces):
    if not word:
        yield ()
    for k in range(1, len(word) + 1):
        if word[:k] in pieces:
            for rest in ways(word[k:], pieces):
                yield (pieces[word[:k]], *rest)


def test_recursions_sum_over_all_segmentations():
    v = Vocabulary(read_ranks(PIECES))
    p = v.initial()
    assert abs(p[v.starts].sum() - 1) < 1e-9 and abs(p[~v.starts].sum() - 1) < 1e-9
    logp, pieces = _weights(np.zeros(len(p)), v.starts, p), {t: i for i, t in enumerate(v.tokens)}
    for lot in ([b" the", b" xqz", " né".encode()], [b" thandhe", b" zzzzxyz"], [b" "]):
        ids = v.spans(lot)
        total, each = forward(ids, logp)[-1], collections.Counter()
        for w, got in zip(lot, total):
            found = [(x, math.exp(sum(logp[i] for i in x))) for x in ways(w, pieces)]
            whole = sum(q for _, q in found)
            assert abs(got - math.log(whole)) < 1e-9
            for x, q in found:
                for i in x:
                    each[i] += q / whole
        n = expected(ids, logp)
        assert abs(n.sum() - sum(each.values())) < 1e-6 and all(abs(n[i] - q) < 1e-9 for i, q in each.items())


def test_no_piece_is_too_long():
    v = Vocabulary(read_ranks(PIECES))
    long = [t for t in read_ranks(PIECES) if len(t) > 24 and b" " not in t[1:]]
    assert long and set(long) <= set(v.tokens) and v.longest == max(map(len, v.tokens))
    v = Vocabulary([b" ", b"a", b" " + b"a" * 40])
    logp = np.append(np.log([0.5, 0.25, 0.125]), -np.inf)
    got = forward(v.spans([b" " + b"a" * 40]), logp)[-1][0]
    assert abs(got - math.log(0.125 + 0.5 * 0.25**40)) < 1e-9


def test_words_by_length():
    words = [b"a", b"bb", b"c", b"x" * 3000]
    seen = {i: t for at, texts in by_length(words) for i, t in zip(at, texts)}
    assert seen == {i: b" " + w for i, w in enumerate(words)}


@pytest.mark.parametrize("block", [4_000_000, 3_000])
def test_base_score_and_held_out_likelihood(spark, block):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    got = {r.doc_id: r for r in score_documents(docs, held, PIECES, block).collect()}
    tokens = {r.doc_id: [*WORDS.findall(low(r.text)), None] for r in docs.collect()}
    train = {i for i in tokens if zlib.crc32(str(i).encode()) % 10}
    count = collections.Counter(w for i in train for w in tokens[i])
    n, norm = sum(count.values()), math.log10(sum(count.values()) + 0.1 * (len(count) + 1))
    assert set(got) == set(tokens)
    for i, own in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(own), sum(count[w] > 0 for w in own), n)
        assert abs(r.base_score - sum(math.log10(count[w] + 0.1) - norm for w in own)) < 1e-6 * len(own)
        assert r.score < 0
    out = [got[i] for i in tokens if i not in train]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_edge_cases(spark):
    rows = [(1, "The the", "en"), (1, "The the", "en"), (None, "other é 　x", None), (2, None, "en"), (3, "", None), (4, "q" * 3000, "fr")]
    docs = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "doc_id long, text string, lang string, score double, block int")
    got = score_documents(docs, F.col("doc_id") == 4, PIECES).collect()
    assert len(got) == 6 and [r.n_tokens for r in got if r.doc_id in (2, 3)] == [1, 1]
    assert all(math.isfinite(r.score) and r.train_tokens == 12 for r in got)  # 2 + 2 + 3 words and 5 ends
    assert [r.n_known for r in got if r.doc_id == 4] == [1]
    none = score_documents(docs, F.lit(True), PIECES).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and math.isfinite(r.score) for r in none)
    assert score_documents(docs.limit(0), F.lit(False), PIECES).collect() == []


def test_vocabularies_that_differ_anywhere_stay_apart():
    from segmint.llm.lattice_lm import _vocabulary
    one = [b"%d" % i for i in range(5000)]
    other = one[:1503] + [b"x"] + one[1504:]
    assert _vocabulary(one) is _vocabulary(list(one)) and _vocabulary(one) is not _vocabulary(other)
