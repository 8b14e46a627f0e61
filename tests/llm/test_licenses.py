"""Licence scans: base places by brute force, own templates, weights, defined edge cases."""

import re

import duckdb
import pytest

from segmint.llm.licenses import BASE, LOWER, UPPER, idf, license_digest, license_sql, scan_licenses, templates

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COPY = str.maketrans(UPPER, LOWER)
NOTICES = ("Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "GNU General Public License, version 3",
           "Licensed under CC BY-NC 4.0.", "mit license MIT-LICENSE\nmit", "apache  license", "the license of mit", "General Public", "Lesser General Public License",
           "Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this Software and associated documentation files")


def texts():
    filler = "der mit lizenz apache general and the Ünïcode 猫 of 42 license public x"
    out = [None, "", " .,; ", "mit", "MIT license", "mıt license", "\x00mit\x7flicense", "İMIT license", "K license mit license"]
    out += list(NOTICES) + [f"{filler} {a} {filler} {b}" for a in NOTICES for b in NOTICES]
    return out + ["license " * 6_000 + "mit license", "mit license " * 4_000, "released under the mit license " * 3]


def plain(text, weights, known):
    """All places of all templates by trying every start."""
    words = WORD.findall((text or "").translate(COPY))
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    base = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
    labels, score = set(), 0.0
    for t in known:
        first, last = t.key()[0], t.key()[-1]
        for p in range(len(words)):
            if words[p] != t.words[first] or not all(0 <= p - first + q < len(words) and words[p - first + q] == t.words[q] for q in t.key()):
                continue
            matched = sum(weights[w] for q, w in enumerate(t.words) if 0 <= p - first + q < len(words) and words[p - first + q] == w)
            labels.add(t.label)
            score = max(score, matched / sum(weights[w] for w in t.words))
    starts = [i for i, _ in base]
    return (len(words), len(base), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "a", 1) for i, t in enumerate(texts())] + [(None, "MIT License", None, None), (3, "MIT License", "b", 2), (3, "MIT License", "b", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, words string, n_words int").repartition(4)


def test_against_plain_version(docs):
    known = templates()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = [set(WORD.findall((t or "").translate(COPY))) for _, t in rows]
    weights = {w: idf(len(rows), sum(w in f for f in found)) for t in known for w in t.words}
    got = [tuple(r) for r in license_digest(scan_licenses(docs)).collect()]
    assert sorted(got, key=str) == sorted([(i, *plain(t, weights, known)) for i, t in rows], key=str)
    by_text = {t: labels for (i, *_, labels, _), t in [((i, *plain(t, weights, known)), t) for i, t in rows]}
    assert by_text[NOTICES[1]] == "apache,apache-2.0" and by_text[NOTICES[3]] == "cc-by-nc-4.0" and by_text[NOTICES[8]] == "gpl,lgpl"


def test_sql_gives_the_same(docs):
    documents = docs.select("doc_id", "text").toPandas()
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("documents", documents)
    want = [tuple(r) for r in con.sql(license_sql()).fetchall()]
    assert sorted(map(tuple, license_digest(scan_licenses(docs)).collect()), key=str) == sorted(want, key=str)


def test_places_of_own_templates(spark):
    known = templates(base=(), more=(("a", "x [b c] y [d]"), ("b", "[c c]")))
    docs = spark.createDataFrame([(1, "b c z d c c c x b c y d")], "doc_id int, text string")
    places = scan_licenses(docs, known).first().places
    assert sorted((p.label, p.base, p.start, p.end) for p in places) == [("a", False, 0, 4), ("a", False, 8, 12), ("b", False, 4, 6), ("b", False, 5, 7)]
    assert [p.score for p in places if p.start == 8] == [1.0]
    with pytest.raises(ValueError):
        templates(base=(("x", "no key phrase"),))


def test_no_python_and_no_shuffle_of_texts(docs):
    plan = license_digest(scan_licenses(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "hashpartitioning" not in plan and len(BASE) == 3


def test_empty(spark):
    assert license_digest(scan_licenses(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
