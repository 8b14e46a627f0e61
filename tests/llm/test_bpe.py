"""Byte-level BPE against tiktoken, with exact round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from segmint.llm.bpe import LONG, BytePairEncoder, decode_documents, encode_documents, read_ranks

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(1)
    pool = [chr(c) for c in [*range(0x250), *[0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x180E, 0x200B, 0x2028, 0x3000, 0xFEFF] * 5, *range(0x4E00, 0x4E20), *range(0x1F600, 0x1F610)]]
    out = ["".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(400)]
    out += ["".join(rng.choices("thehanerin", k=2000)) for _ in range(5)]
    return [*out, "", " " * 3000, "a" * 5000, "ab" * 3000, "<|endoftext|>", "xyz" * LONG + " " + "th" * 700]


def test_as_tiktoken(reference):
    enc = BytePairEncoder(read_ranks(VOCABULARY), PATTERN)
    for text, ids in zip(texts(), enc.encode(texts())):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
        assert enc.decode(ids) == text.encode()


def test_matrix_and_heap_agree():
    enc = BytePairEncoder(read_ranks(VOCABULARY), PATTERN)
    rng = random.Random(3)
    for n in (2, 3, 9, 31, 33, 200, LONG):
        piece = "".join(rng.choices("aehinorst", k=n)).encode()
        if piece not in enc.whole:
            assert enc.encode_pieces([piece])[0] == enc._merge_long(piece)


def test_documents(spark, reference):
    rows = [(1, "Hello there"), (1, "Hello there"), (None, "été"), (2, None), (3, ""), (4, "x" * 40_000 + " y" * 9)]
    docs = spark.createDataFrame([(i, t, 7, b"x") for i, t in rows], "doc_id long, text string, n_tokens int, ids binary")
    coded = encode_documents(docs, VOCABULARY, PATTERN, decode=True)
    got = sorted([(r.doc_id, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in coded.collect()], key=str)
    assert got == sorted([(i, len(reference.encode_ordinary(t or "")), reference.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows], key=str)
    back = decode_documents(coded, VOCABULARY, PATTERN).collect()
    assert sorted([(r.doc_id, bytes(r.decoded)) for r in back], key=str) == sorted([(i, (t or "").encode()) for i, t in rows], key=str)
    assert encode_documents(docs.limit(0), VOCABULARY, PATTERN).collect() == []


def test_query(spark, reference):
    from segmint.llm.queries import op9_byte_bpe
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op9_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    for i, t in docs.items():
        ids = reference.encode_ordinary(t)
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
