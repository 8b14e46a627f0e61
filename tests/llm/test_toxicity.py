"""Toxicity: the composed grammar by hand, held-out accuracy, edge cases."""

import pytest

from segmint.llm import toxicity
from segmint.llm.queries import op4_toxicity
from segmint.llm.toxicity import END, INSULT, NEGATED, NEGATION, OTHER, REPORT, REPORTED, TARGET, TARGETED, THREAT, ToxicityModel, fit, grammar, score

MODEL = ToxicityModel({"idiot": 5.0, "scum": 4.0, "blub*": 3.0}, (2.0, 1.0, 1.0), -3.0)


def test_machine_is_the_product_of_its_parts():
    machine = grammar()

    def run(symbols):
        state, out = 0, []
        for s in symbols:
            state, f = machine[state][s]
            out.append(round(f, 9))
        return out
    assert run([OTHER, INSULT, THREAT, END]) == [0, 1, 1, 0]
    assert run([TARGET, OTHER, OTHER, INSULT]) == [0, 0, 0, TARGETED] and run([TARGET, OTHER, OTHER, OTHER, INSULT])[-1] == 1
    assert run([NEGATION, OTHER, INSULT])[-1] == NEGATED and run([REPORT] + [OTHER] * 9 + [INSULT])[-1] == REPORTED
    assert run([REPORT, TARGET, NEGATION, INSULT])[-1] == round(TARGETED * NEGATED * REPORTED, 9)
    assert run([NEGATION, TARGET, REPORT, END, INSULT])[-1] == 1


def test_clauses_not_words():
    assert MODEL.clauses("You idiot. Fine day; the Scum!") == [("You idiot", 5.0 * TARGETED), (" the Scum", 4.0)]
    assert MODEL.clauses("not an idiot")[0][1] < MODEL.clauses("an idiot")[0][1] < MODEL.clauses("you idiot")[0][1]
    assert MODEL.clauses("BLUBBERN")[0][1] == 3.0 and MODEL.clauses("blu") == []
    assert MODEL.clauses("they will kill")[0][1] > 0
    assert MODEL.score(MODEL.clauses(None)) == MODEL.score(MODEL.clauses("")) < 0.5


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = op4_toxicity(spark, sf).collect()
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) >= 0.98
    toxic = [r for r in held if labels[r.doc_id] == 1]
    # 97 toxic rows are held out here; 5 of them are junk texts (repeated words, tables) without any insult.
    assert sum(r.predicted for r in toxic) / len(toxic) >= 0.88


@pytest.fixture(scope="module")
def tiny(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (None, "idiot", "a"), (3, "you idiot", "a"), (3, "you idiot", "a")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(3, 1), (3, 0), (2, 0), (None, 1), (1, None)], "doc_id long, toxic int")
    return docs, labels


def test_edge_cases(tiny):
    docs, labels = tiny
    got = score(docs, MODEL).collect()
    assert len(got) == 5 and sorted(len(r.clauses) for r in got) == [0, 0, 1, 1, 1]
    model = fit(docs, labels)
    assert model.score([]) < 1 and score(docs.limit(0), model).collect() == []
    assert fit(docs, labels.limit(0)).score([("x", 9.0)]) == 0.0


def test_copies_are_no_evidence(spark):
    """A word that only copies and near copies of one toxic text hold is not learnt, one that many texts hold is."""
    rows, labels = [], []
    word = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    for i in range(400):
        toxic = i % 4 == 0
        rows.append((i, f"{word(i)} alpha {word(i + 1)} " + (f"{word(i * 7)} slur {word(i * 3)}" if toxic else f"{word(i * 5)} beta")))
        labels.append((i, int(toxic)))
    for i in range(400, 480):
        rows.append((i, f"some copied text with oddword inside {word(i)}"))
        labels.append((i, 1))
    model = fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "slur" in model.insults and "oddword" not in model.insults and "alpha" not in model.insults
    assert toxicity.terms("slurs") == ["slurs", "slur*", "slurs*"]
