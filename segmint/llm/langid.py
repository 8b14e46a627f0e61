"""Language identification in two steps: the family, then the language within it.

A text is the square root of its counts of hashed two- and three-byte sequences
(lower case, ASCII digits and marks as blanks), scaled to length one.  A
logistic regression tells the families apart; within a family a linear support
vector machine for every two languages votes.  Both are fitted by MLlib on a
sample of at most about ``per_language`` labelled rows for each language, drawn
by a hash of the id (a documented bound of the fit; prediction covers all rows).
The score is the family's probability times the language's mean pairwise one.

Defined results
* a text that is null, empty or without a letter is ``und`` with score 0;
* one row per row of the input, repeated and null ids included;
* without labelled rows (or an empty table to learn from) every text is ``und``;
* equal scores go to the language that sorts first; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmint.llm._util import arrow_schema, cut

#: ISO 639-1 codes by family; a language that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "indic": "hi bn ur pa mr gu ne si",
    "turkic": "tr az kk uz ky tk",
    "uralic": "fi et hu",
    "semitic": "ar he mt am",
    "dravidian": "ta te kn ml",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
DIMS_BITS = 12
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_PLAIN = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))
_STEP = 1 << 22


def features(text: str) -> np.ndarray:
    counts = np.zeros(1 << DIMS_BITS, dtype=np.int64)
    data = b" " + b" ".join(text.lower().encode().translate(_PLAIN).split()) + b" "
    for k in range(0, len(data), _STEP):  # neighbouring parts overlap by two bytes
        a = np.frombuffer(data[k:k + _STEP + 2], dtype=np.uint8).astype(np.uint32)
        two = a[:-1] << np.uint32(8) | a[1:]
        three = two[:-1] << np.uint32(8) | a[2:] | np.uint32(1 << 24)
        for g in (two[:_STEP], three):
            counts += np.bincount(g * np.uint32(2654435761) >> np.uint32(32 - DIMS_BITS), minlength=1 << DIMS_BITS)
    x = np.sqrt(counts)
    return x / max(np.linalg.norm(x), 1e-12)


@dataclass
class LanguageModel:
    """Weights of the fitted steps; its size is fixed by the languages, not by the rows."""

    families: dict[str, list[str]] = field(default_factory=dict)
    family_weights: np.ndarray | None = None  # a row per family in sorted order, the intercept last
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.families or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0
        x = np.append(features(text), 1.0)
        names = sorted(self.families)
        share, name = 1.0, names[0]
        if self.family_weights is not None:
            z = self.family_weights @ x
            p = np.exp(z - z.max())
            name, share = names[int(p.argmax())], float(p.max() / p.sum())
        langs = self.families[name]
        if len(langs) == 1:
            return langs[0], share
        votes = dict.fromkeys(langs, 0.0)
        for a, b in itertools.combinations(langs, 2):
            first = 1 / (1 + np.exp(-2 * float(self.pairs[a, b] @ x)))
            votes[a] += first
            votes[b] += 1 - first
        best = max(langs, key=lambda n: (votes[n], [-ord(c) for c in n]))
        return best, share * votes[best] / (len(langs) - 1)


def fit(docs: DataFrame, per_language: int = 1000, seed: int = 7) -> LanguageModel:
    """Fit on the rows of ``docs`` (doc_id, text, lang) that have a language and a letter in their text."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not counts:
        return LanguageModel()
    share = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.length("text")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    schema = arrow_schema(docs.sparkSession, "lang string, x array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256).to_pydict()
                ok = [(n, t) for n, t in zip(b["lang"], b["text"]) if _LETTER.search(t)]
                yield pa.RecordBatch.from_pydict({"lang": [n for n, _ in ok], "x": [features(t) for _, t in ok]}, schema=schema)

    sample = cut(rows.where(draw < share[F.col("lang")]).select("lang", "text").mapInArrow(run, "lang string, x array<double>"))
    present = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    model = LanguageModel()
    for n in present:
        model.families.setdefault(FAMILY_OF.get(n, n), []).append(n)
    if not present:
        return model

    def labelled(members: list[list[str]]) -> DataFrame:
        label = F.create_map(*[F.lit(v) for i, langs in enumerate(members) for n in langs for v in (n, float(i))])[F.col("lang")]
        return sample.where(F.col("lang").isin([n for m in members for n in m])).select(label.alias("label"), array_to_vector("x").alias("features"))

    names = sorted(model.families)
    if len(names) > 1:
        m = LogisticRegression(regParam=1e-4, maxIter=40, family="multinomial", standardization=False).fit(labelled([model.families[n] for n in names]))
        model.family_weights = np.hstack([m.coefficientMatrix.toArray(), m.interceptVector.toArray()[:, None]])
    for langs in model.families.values():
        for a, b in itertools.combinations(langs, 2):
            m = LinearSVC(regParam=1e-4, maxIter=40, standardization=False).fit(labelled([[b], [a]]))
            model.pairs[a, b] = np.append(m.coefficients.toArray(), m.intercept)
    return model


def marked(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of ``docs`` with ``__lang``, ``__score`` and ``__letter`` (whether the text has one) after them; only the text goes through Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang: string, score: double, letter: boolean>")
    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(((*shared.value.predict(t), bool(t and _LETTER.search(t))) for t in texts), columns=["lang", "score", "letter"])

    own = docs.withColumn("__found", found.asNondeterministic()(F.col("text").cast("string")))  # not evaluated again by a filter on it
    return own.select(*[own[c] for c in docs.columns], F.col("__found.lang").alias("__lang"), F.col("__found.score").alias("__score"), F.col("__found.letter").alias("__letter"))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of ``docs`` with ``__lang`` and ``__score`` after them."""
    return marked(docs, model).drop("__letter")


def identify(docs: DataFrame, labelled: DataFrame, per_language: int = 1000) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs``, learning from ``labelled`` (doc_id, text, lang)."""
    found = predict(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), fit(labelled, per_language))
    return found.select("doc_id", F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))
