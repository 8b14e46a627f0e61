"""The corpus pipeline: each stage against a plain version on its own input, and odd tables."""

import base64
import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from segmint.llm import queries
from test_simhash import near, plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"
BLANK = re.compile("[\x20\x09-\x0d]")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows after each stage, written and read again."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(out)
        docs = spark.read.parquet(out)
        frames.append(docs)
    return [f.collect() for f in frames], [f.columns for f in frames]


def test_columns(stages):
    _, columns = stages
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert all(c == ["doc_id", "text", "lang", "source", "n_chars"] for c in columns[:-1])


def test_language_stage_keeps_every_text_with_a_letter(stages):
    before, after = stages[0][0], stages[0][1]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if any(c.isalpha() for c in r.text or ""))
    langs = {r.doc_id: r.lang for r in before}
    assert np.mean([r.lang == langs[r.doc_id] for r in after]) > 0.95


def test_exact_stage(stages):
    before, after = stages[0][1], stages[0][2]
    best = {}
    for r in before:
        n = BLANK.sub("", r.text)
        best[n] = min(best.get(n, (1, 0)), (-len(r.text), r.doc_id))
    assert sorted(r.doc_id for r in after) == sorted(i for _, i in best.values())


def test_near_stage(stages):
    before, after = stages[0][2], stages[0][3]
    fp = {r.doc_id: plain_fingerprint(r.text) for r in before}
    roots = plain_components(sorted(fp), lambda a, b: near(4)(fp[a], fp[b]))
    assert sorted(r.doc_id for r in after) == sorted(set(roots.values()))


def test_mixing_stage(spark, stages):
    before, after = stages[0][3], stages[0][4]
    docs = spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")
    want = queries.mix(docs, queries.tree(), queries.MIX_WEIGHTS, queries.MIX_SHARE, queries.MIX_EPOCHS, queries.MIX_SEED)
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in want.collect())


def test_token_stage(stages):
    before, after = stages[0][4], stages[0][5]
    with open(queries.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tk = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in before}
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)
    for r in after:
        assert np.frombuffer(r.ids, "<u4").tolist() == tk.encode_ordinary(texts[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "the same text here", "en", "src0", 3, "p"), (1, "the same text here", "en", "src0", 3, "p"), (None, "the same  text here", "en", "src1", None, "q"),
            (None, "der andere Text und das", None, None, 1, "q"), (2, None, "en", "src0", 1, None), (3, "", "en", "src0", 1, "r"), (4, "!!! 123", "en", "src9", 1, "s"),
            (5, "word " * 5000, "en", "src0", 1, "t"), (5, "another text of that id", "en", "src0", 1, "t")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string")


def test_odd_rows_run_through(spark, odd):
    docs = odd
    names = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF)
        names.append(docs.columns)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert names == [odd.columns] * 3
    assert sorted([(r.doc_id, r.text[:12]) for r in docs.collect()], key=str) == sorted(
        [(None, "the same  te"), (None, "der andere T"), (5, "word word wo"), (5, "another text")], key=str)  # the longer of the equal texts
    for _, stage in corpus_pipeline.STAGES[3:]:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)


def test_empty_table_runs_through(spark, odd):
    docs = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []
        docs = spark.createDataFrame([], docs.schema)


def test_registered():
    import __spark_entry__
    names = [n for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in __spark_entry__.queries()
    assert set(queries.ORACLE_SQL) <= set(__spark_entry__.oracle_sql())


def test_language_stage_keeps_documents_where_no_language_is_known(spark):
    rows = [(i, f"a clean text {i}", None, "web", 12) for i in range(20)] + [(30, None, None, "web", 0), (31, "12 34", None, "web", 5), (32, "", None, "web", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(tuple, corpus_pipeline.language_id(spark, docs, SF).collect())) == rows[:20]
