"""Language ID: held-out accuracy and defined edge cases."""

import numpy as np
import pytest

from segmint.llm.langid import FAMILY_OF, UNKNOWN, LanguageModel, features, fit, identify, predict
from segmint.llm.queries import op7_language_id

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang")


@pytest.fixture(scope="module")
def model(labelled):
    return fit(labelled.where("doc_id % 3 <> 0"))


def test_query_is_right_on_held_out_rows(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = op7_language_id(spark, DIR).collect()
    assert len(got) == len(langs) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert 0.15 < len(held) / len(got) < 0.35
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) >= 0.97


def test_family_first(model):
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    assert set(model.pairs) == {("de", "en"), ("es", "fr")} and FAMILY_OF["pt"] == "romance"


def test_edge_cases(spark, model):
    rows = [(1, None, 1.5), (2, "", 1.5), (3, "123 | ... 456\n", 1.5), (None, "the thing and of the", 1.5), (4, "der die und das", 1.5), (4, "der die und das", 1.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = predict(docs, model)
    assert got.columns == ["doc_id", "text", "score", "__lang", "__score"]
    by = {(r.doc_id, r.text): r for r in got.collect()}
    assert all(by[k, t]["__lang"] == UNKNOWN and by[k, t]["__score"] == 0 for k, t in ((1, None), (2, ""), (3, "123 | ... 456\n")))
    assert by[None, "the thing and of the"]["__lang"] == "en" and by[4, "der die und das"]["__lang"] == "de" and by[4, "der die und das"]["score"] == 1.5
    assert len(got.collect()) == 6
    assert predict(docs.limit(0), model).collect() == []


def test_nothing_to_learn_from(spark, labelled):
    none = labelled.where("lang = 'xx'")
    assert {r.lang_pred for r in identify(labelled.limit(5), none).collect()} == {UNKNOWN}
    one = fit(labelled.where("lang = 'fr'"))
    assert one.predict("bonjour")[0] == "fr" and one.predict("bonjour")[1] == 1.0
    assert LanguageModel().predict("a") == (UNKNOWN, 0.0)


def test_features_of_long_texts_are_those_of_the_whole(monkeypatch):
    from segmint.llm import langid
    text = "The quick brown fox, été 123! " * 300
    want = features(text)
    monkeypatch.setattr(langid, "_STEP", 37)
    assert np.allclose(features(text), want) and abs(np.linalg.norm(want) - 1) < 1e-9
