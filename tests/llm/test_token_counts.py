"""Token counts of sections against another library's offsets and plain allocation."""

import bisect
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from segmint.llm.token_counts import RULES, allocate, count_tokens, flat

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def split_lines(text):
    parts = [s for s in text.replace("\n", "\n\0").split("\0")]
    return parts[:-1] if len(parts) > 1 and not parts[-1] else parts


def test_lines_against_offsets_of_another_library(spark):
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tk.encode_special_tokens = True
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(10_000, "\n\n\n"), (10_001, "été\n日本語\nx"), (10_002, "a\n \n b\r\n")]
    got = {}
    for r in count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), VOCABULARY, PATTERN).collect():
        got.setdefault(r.doc_id, []).append((r.section_no, r.start, r.end, r.n_tokens))
    for i, text in rows:
        starts = [0]
        for s in split_lines(text):
            starts.append(starts[-1] + len(s))
        n = [0] * (len(starts) - 1)
        for a, _ in tk.encode(text, add_special_tokens=False).offsets:
            n[bisect.bisect_right(starts, a) - 1] += 1
        assert sorted(got[i]) == [(k, starts[k], starts[k + 1], n[k]) for k in range(len(n))]


def plain(starts, ends, owner, sections, rule):
    n = [0.0] * (sections + 1)
    for a, b in zip(starts, ends):
        own = owner[a:b]
        if rule in ("first", "last"):
            n[own[0 if rule == "first" else -1]] += 1
        else:
            runs = []
            for k in own:
                if runs and runs[-1][0] == k:
                    runs[-1][1] += 1
                else:
                    runs.append([k, 1])
            for k, c in runs if rule == "share" else [(max(runs, key=lambda z: z[1])[0], b - a)]:
                n[k] += c / (b - a)
    return n


@pytest.mark.parametrize("rule", RULES)
def test_allocation(rule):
    rng = random.Random(4)
    for _ in range(300):
        size = rng.randint(1, 40)
        ends = np.array(sorted({*rng.sample(range(1, size + 1), rng.randint(0, min(6, size))), size}))
        starts = np.concatenate([[0], ends[:-1]])
        cuts = sorted(rng.sample(range(size + 1), 2 * rng.randint(0, min(3, (size + 1) // 2))))
        spans = list(zip(cuts[::2], cuts[1::2]))  # apart from each other
        owner = [next((k for k, (s, e) in enumerate(spans) if s <= p < e), len(spans)) for p in range(size)]
        n, rest = allocate(starts, ends, np.array(spans), rule) if spans else (np.zeros(0), float(len(ends)))
        assert np.allclose([*n, rest], plain(starts, ends, owner, len(spans), rule))


def test_overlaps_belong_to_the_one_that_starts_last():
    rng = random.Random(5)
    for _ in range(300):
        size = rng.randint(0, 30)
        spans = [(rng.choice([None, rng.randint(-2, 32)]), rng.randint(-2, 34)) for _ in range(rng.randint(0, 5))]
        pieces, of = flat(spans, size)
        owner = [None] * size
        for (s, e), k in zip(pieces.tolist(), of):
            owner[s:e] = [k] * (e - s)
        for p in range(size):
            over = [(max(0, s), min(size, e), k) for k, (s, e) in enumerate(spans) if s is not None and s <= p < e]
            assert owner[p] == (max(over)[2] if over else None)


def test_stated_spans_and_edge_cases(spark):
    rows = [(1, "one two three", [(0, 7), (7, 99)]), (1, "one two three", [(4, 7)]), (2, None, [(0, 5)]), (None, "x", None), (3, "été là", [(0, 3), None, (None, 2)]), (4, "", [])]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, parts array<struct<start: int, end: int>>, n_tokens int").coalesce(1)
    got = [tuple(r) for r in count_tokens(docs, VOCABULARY, PATTERN, spans="parts").collect()]
    assert got == [(1, 0, 0, 7, 2), (1, 1, 7, 99, 1), (1, 0, 4, 7, 0), (1, None, None, None, 3), (2, 0, 0, 5, 0), (None, None, None, None, 1),
                   (3, 0, 0, 3, 2), (3, 1, None, None, 0), (3, 2, None, 2, 0), (3, None, None, None, got[-1][4])]
    whole = [tuple(r) for r in count_tokens(docs.where("doc_id in (2, 4)"), VOCABULARY, PATTERN).collect()]
    assert whole == [(2, 0, 0, 0, 0), (4, 0, 0, 0, 0)]
    assert count_tokens(docs.limit(0), VOCABULARY, PATTERN).collect() == []
    shares = count_tokens(docs.where("doc_id = 1"), VOCABULARY, PATTERN, rule="share", spans="parts")
    assert sum(r.n_tokens for r in shares.collect()) == pytest.approx(6)
    with pytest.raises(ValueError):
        count_tokens(docs, VOCABULARY, PATTERN, rule="other")
