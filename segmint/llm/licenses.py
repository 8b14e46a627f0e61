"""Licence scans over a positional rare-token index.

A template is the wording of a notice; the words in brackets are its mandatory
key phrases, the others only add to its score.  The index holds, for every
template, its mandatory words with their positions, rarest first by IDF over all
documents.  A file is scanned in three steps, each one an array expression:

1. *Look-up*: the places of the file's highest-IDF licence words, those that
   are the rarest mandatory word of some template, meet the postings
   (template, position) of that word and give starts = place - position.
2. *Intersection*: a start stays if the template's next rarest words stand at
   their own positions from it.
3. *Verification*: all words of the mandatory key phrases stand there.

A template that occurs has its rarest mandatory word, whichever that is, so no
place is lost and nothing is capped.  The score of a place is the share of the
template's IDF weight that stands at its positions.

Only DataFrame functions are used.  The first job counts the documents of every
licence word (partial counts: as many rows a task as there are licence words);
the second is a map over the documents without any shuffle.  The driver
holds the licence words' counts, whose number the templates bound.

Defined results
* null text counts as empty: no words, no places, labels empty, score 0;
* a row of the result for every row of the input, repeated and null ids included;
* an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of digits, letters and everything outside ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: How many of a template's rarest words are intersected before its key phrases are verified.
RARE = 3

#: The base phrases and their labels, as key phrases of short notices.
BASE = (
    ("mit", "released under the [mit license]"),
    ("apache", "licensed under the [apache license]"),
    ("gpl", "licensed under the gnu [general public license]"),
)
#: Wordings of public licences, with labels of this operator.
TEMPLATES = (
    ("mit-grant", "[permission is hereby granted free of charge to any person obtaining a copy] of this software and associated documentation files"),
    ("apache-2.0", "licensed under the [apache license version 2 0] the license you may not use this file except in compliance with the license"),
    ("gpl-2.0", "under the terms of the gnu [general public license version 2] as published by the free software foundation"),
    ("gpl-3.0", "this work is licensed under the gnu [general public license version 3]"),
    ("lgpl", "under the terms of the gnu [lesser general public license] as published by the free software foundation"),
    ("agpl", "under the terms of the gnu [affero general public license] as published by the free software foundation"),
    ("bsd", "[redistribution and use in source and binary forms with or without modification are permitted] provided that the following conditions are met"),
    ("bsd-3-clause", "[neither the name of] the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("isc", "[permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted]"),
    ("mpl-2.0", "this source code form is subject to the terms of the [mozilla public license v 2 0]"),
    ("epl-2.0", "this program is made available under the terms of the [eclipse public license] v 2 0"),
    ("boost-1.0", "distributed under the [boost software license version 1 0]"),
    ("zlib", "this software is provided as is without any express or implied warranty [in no event will the authors be held liable for any damages]"),
    ("unlicense", "this is free and unencumbered software [released into the public domain]"),
    ("cc0-1.0", "to the extent possible under law the author has [waived all copyright and related] or neighboring rights"),
    ("cc-by-4.0", "licensed under [cc by 4 0]"),
    ("cc-by-sa-4.0", "licensed under [cc by sa 4 0]"),
    ("cc-by-nc-4.0", "licensed under [cc by nc 4 0]"),
    ("cc-by-nd-4.0", "licensed under [cc by nd 4 0]"),
    ("cc-by-nc-sa-4.0", "licensed under [cc by nc sa 4 0]"),
    ("cc-by-nc-nd-4.0", "licensed under [cc by nc nd 4 0]"),
    ("cc", "this work is licensed under a [creative commons attribution] international license"),
)


@dataclass(frozen=True)
class Template:
    label: str
    base: bool
    words: tuple[str, ...]
    must: tuple[bool, ...]

    @classmethod
    def parse(cls, label: str, notice: str, base: bool) -> Template:
        words, must, inside = [], [], False
        for part in re.findall(r"\[|\]|[^\[\] ]+", notice):
            if part in "[]":
                inside = part == "["
            else:
                words.append(part)
                must.append(inside)
        if not any(must):
            raise ValueError(f"the template of {label} has no key phrase")
        return cls(label, base, tuple(words), tuple(must))

    def key(self) -> list[int]:
        return [q for q, m in enumerate(self.must) if m]


def templates(base=BASE, more=TEMPLATES) -> list[Template]:
    return [Template.parse(label, notice, own is base) for own in (base, more) for label, notice in own]


def idf(n_docs: int, n_with: int) -> int:
    """The weight of a word in thousandths, at least 1."""
    return 1 + math.floor(1000 * math.log((n_docs + 1.0) / (n_with + 1.0)) + 0.5)


def _words() -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORDS), F.lit(0))


def word_weights(docs: DataFrame, known: list[Template]) -> dict[str, int]:
    """IDF of every word of the templates over all rows of ``docs``."""
    vocabulary = sorted({w for t in known for w in t.words})
    found = F.array_intersect("words", F.array(*map(F.lit, vocabulary)))
    # The empty word stands in every document, so that one job counts the documents too.
    counts = (docs.select(_words().alias("words")).select(F.explode(F.concat(F.array(F.lit("")), found)).alias("word"))
              .groupBy("word").count())
    got = {r["word"]: r["count"] for r in counts.collect()}
    return {w: idf(got.get("", 0), got.get(w, 0)) for w in vocabulary}


def _list(items: list[str]) -> str:
    return f"array({', '.join(items)})"


def _at(q: int, word: str, weight: int = 0) -> str:
    return f"named_struct('q', {q}, 'w', '{word}', 'weight', {weight}L)"


def scan_licenses(docs: DataFrame, known: list[Template] | None = None) -> DataFrame:
    """doc_id, n_words and places (label, base, start and end of the key phrases in words, score) of every row of ``docs``."""
    known = known or templates()
    weight = word_weights(docs, known)
    postings: dict[str, list[str]] = {}
    rare, must, whole = [], [], []
    for t, one in enumerate(known):
        by_idf = sorted(one.key(), key=lambda q: (-weight[one.words[q]], q))
        postings.setdefault(one.words[by_idf[0]], []).append(f"named_struct('t', {t}, 'q', {by_idf[0]})")
        rare.append(_list([_at(q, one.words[q]) for q in by_idf[:RARE]]))
        must.append(_list([_at(q, one.words[q]) for q in by_idf]))
        whole.append(_list([_at(q, w, weight[w]) for q, w in enumerate(one.words)]))
    index = "map(" + ", ".join(f"'{w}', {_list(p)}" for w, p in sorted(postings.items())) + ")"
    heads = ", ".join(f"'{w}'" for w in sorted(postings))
    about = _list([f"named_struct('label', '{x.label}', 'base', {str(x.base).lower()}, 'first', {x.key()[0]}, 'last', {x.key()[-1]}, "
                   f"'total', {sum(weight[w] for w in x.words)}L)" for x in known])

    def stands(lists: list[str]) -> str:
        return f"forall(get({_list(lists)}, c.t), x -> get(words, c.d + x.q) <=> x.w)"

    words = docs.select(F.col("doc_id"), _words().alias("words"))
    looked_up = words.withColumn("starts", F.expr(f"""
        flatten(transform(array_compact(transform(words, (w, i) -> CASE WHEN w IN ({heads}) THEN i END)),
                          i -> transform(element_at({index}, get(words, i)), p -> named_struct('t', p.t, 'd', i - p.q))))"""))
    verified = looked_up.withColumn("starts", F.expr(f"filter(filter(starts, c -> {stands(rare)}), c -> {stands(must)})"))
    place = f"""transform(starts, c -> transform(array(get({about}, c.t)), a -> named_struct(
        'label', a.label, 'base', a.base, 'start', CAST(c.d + a.first AS BIGINT), 'end', CAST(c.d + a.last + 1 AS BIGINT),
        'score', CAST(aggregate(get({_list(whole)}, c.t), 0L, (s, x) -> s + CASE WHEN get(words, c.d + x.q) <=> x.w THEN x.weight ELSE 0L END) AS DOUBLE) / a.total))[0])"""
    return verified.select("doc_id", F.size("words").cast("long").alias("n_words"), F.expr(place).alias("places"))


def license_digest(found: DataFrame) -> DataFrame:
    """The report of every row of :func:`scan_licenses`: base places, labels and the best score."""
    def labels(of: str) -> Column:
        return F.expr(f"array_join(array_sort(array_distinct(transform({of}, p -> p.label))), ',')")

    start = F.expr("transform(base, p -> p.start)")
    return found.withColumn("base", F.expr("filter(places, p -> p.base)")).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
        labels("base").alias("base_labels"), labels("places").alias("labels"),
        F.coalesce(F.array_max(F.expr("transform(places, p -> p.score)")), F.lit(0.0)).alias("score"))


def license_sql(known: list[Template] | None = None) -> str:
    """DuckDB SQL of :func:`license_digest` over ``documents``: joins of all words with the templates' words."""
    known = known or templates()
    rows = ", ".join(f"({t}, '{x.label}', {x.base}, {q}, '{w}', {m})" for t, x in enumerate(known) for q, (w, m) in enumerate(zip(x.words, x.must)))
    return f"""
        WITH docs AS (SELECT row_number() OVER () AS rid, doc_id,
                             regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS ws FROM documents),
             tw(t, label, base, q, w, must) AS (VALUES {rows}),
             words AS (SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM docs),
             occ AS (SELECT * FROM words WHERE w IN (SELECT w FROM tw)),
             df AS (SELECT w, count(DISTINCT rid) AS n FROM occ GROUP BY w),
             weights AS (SELECT w, 1 + round(1000 * ln(((SELECT count(*) FROM docs) + 1.0::DOUBLE) / (coalesce(n, 0) + 1.0::DOUBLE)))::BIGINT AS weight
                         FROM (SELECT DISTINCT w FROM tw) LEFT JOIN df USING (w)),
             about AS (SELECT t, any_value(label) AS label, any_value(base) AS base, min(q) FILTER (must) AS first,
                              count(*) FILTER (must) AS n_must, sum(weight) AS total FROM tw JOIN weights USING (w) GROUP BY t),
             starts AS (SELECT rid, t, i - q AS d FROM occ JOIN tw USING (w) JOIN about USING (t) WHERE must
                        GROUP BY rid, t, i - q, n_must HAVING count(*) = n_must),
             wanted AS MATERIALIZED (SELECT rid, t, d, d + q AS i, w, weight FROM starts JOIN tw USING (t) JOIN weights USING (w)),
             places AS (SELECT rid, t, d, sum(weight) AS matched FROM wanted JOIN occ USING (rid, i, w) GROUP BY rid, t, d),
             found AS (SELECT rid, count(*) FILTER (base) AS n_base, min(d + first) FILTER (base) AS first_word, max(d + first) FILTER (base) AS last_word,
                              string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
                              max(matched::DOUBLE / total::DOUBLE) AS score FROM places JOIN about USING (t) GROUP BY rid)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
        FROM docs LEFT JOIN found USING (rid)"""
