"""Toxicity by a weighted finite-state pattern grammar.

A clause (up to ``.``, ``!``, ``?``, ``;`` or a line end) becomes a string of symbols:
insult, threat, target, negation, reported speech, other word, end.  Four small
transducers read it, each with a weight for the symbols it passes on:

* insults and threats emit their term's weight (learnt) and nothing else does;
* a target within ``REACH`` words before multiplies it up;
* a negation within ``REACH`` words before, or reported speech anywhere before in the
  clause, multiplies it down.

They are composed once into one machine over product states; a clause's score
is the sum along its path.  A text's score is a logistic function of its number
of matched clauses and of the sum and the largest of their scores, fitted by
MLlib on labelled rows.

Insults are learnt: words, and word beginnings of 4 to 6 letters, whose share of
toxic texts is ``RATIO`` times that of others or more, with more evidence than chance
would give any of all terms.  Texts that repeat count once, and a term counts no
more often than it has different neighbours, so that what only copies of one
text share is no insult.  Threats, targets, negations and reported
speech are fixed lists.  Learning takes at most about ``per_class`` rows of each
label, drawn by a hash of the id, and ``max_terms`` terms (documented bounds).

Defined results
* null, empty and clean texts get the score of no match (below one half);
* one row per row of the input, repeated and null ids included;
* without labelled rows of both kinds every score is 0; several labels of a
  doc_id count as the largest; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmint.llm._util import arrow_schema, cut

#: Fixed word lists (en de fr es).
THREATS = "kill hurt destroy murder strangle shoot stab töten umbringen verletzen tuer frapper blesser matar golpear herir"
TARGETS = "you your yours u ur he she they him her them his their du dich dir dein ihr euch sie er tu te toi ton vous votre il elle ils tú ti tu usted ustedes él ella ellos"
NEGATIONS = "not no never neither nor without nicht kein keine nie niemals ohne ne pas jamais aucun sans nunca jamás sin ningún"
REPORTS = "said says wrote quoted reported claims sagte schrieb laut dit écrit selon dijo escribió según"
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, END = range(7)
REACH, RATIO = 3, 8.0
TARGETED, NEGATED, REPORTED, THREAT_WEIGHT = 1.5, 0.4, 0.6, 4.0
_CLAUSES = regex.compile(r"[.!?;\n\r]+")
_WORDS = regex.compile(r"\p{L}+")

#: A transducer: transitions[state][symbol] = (next state, factor on the weight of a match at this symbol).
Machine = list[list[tuple[int, float]]]


def window(trigger: int, reach: int, factor: float, forgets: bool = True) -> Machine:
    """State k > 0: the trigger was ``reach - k`` words ago.  Without ``forgets`` it holds to the end of the clause."""
    rows = []
    for k in range(reach + 1):
        row = []
        for symbol in range(END + 1):
            after = reach if symbol == trigger else 0 if symbol == END else k if not forgets else max(0, k - 1)
            row.append((after, factor if k else 1.0))
        rows.append(row)
    return rows


def compose(a: Machine, b: Machine) -> Machine:
    """Both read the same string; their factors multiply.  State (i, j) is i * len(b) + j."""
    return [[(a[i][s][0] * len(b) + b[j][s][0], a[i][s][1] * b[j][s][1]) for s in range(END + 1)] for i in range(len(a)) for j in range(len(b))]


def grammar() -> Machine:
    emits: Machine = [[(0, 1.0 if s in (INSULT, THREAT) else 0.0) for s in range(END + 1)]]
    return compose(compose(compose(emits, window(TARGET, REACH, TARGETED)), window(NEGATION, REACH, NEGATED)), window(REPORT, 1, REPORTED, forgets=False))


def terms(word: str) -> list[str]:
    """The word and its beginnings; a beginning has a mark after it."""
    return [word] + [word[:n] + "*" for n in (4, 5, 6) if len(word) >= n]


@dataclass
class ToxicityModel:
    insults: dict[str, float] = field(default_factory=dict)
    coefficients: tuple[float, ...] = ()
    intercept: float = 0.0

    def __post_init__(self):
        self.machine = grammar()
        fixed = {w: (s, THREAT_WEIGHT if s == THREAT else 0.0) for s, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in ws.split()}
        self.fixed = fixed
        self.symbols: dict[str, tuple[int, float]] = {}  # words seen so far

    def symbol(self, word: str) -> tuple[int, float]:
        found = self.symbols.get(word)
        if found is None:
            if len(self.symbols) > 300_000:  # a worker's memory only
                self.symbols.clear()
            weight = max((self.insults.get(t, 0.0) for t in terms(word)), default=0.0)
            found = self.symbols[word] = (INSULT, weight) if weight else self.fixed.get(word, (OTHER, 0.0))
        return found

    def clauses(self, text: str | None) -> list[tuple[str, float]]:
        """The matched clauses with their scores."""
        found = []
        for clause in _CLAUSES.split(text or ""):
            path = list(map(self.symbol, _WORDS.findall(clause.lower())))
            if any(s <= THREAT for s, _ in path):
                state, score = 0, 0.0
                for s, w in path:
                    state, factor = self.machine[state][s]
                    score += factor * w
                found.append((clause, score))
        return found

    def features(self, clauses: list[tuple[str, float]]) -> list[float]:
        scores = [s for _, s in clauses]
        return [math.log1p(len(scores)), math.log1p(sum(scores)), max(scores, default=0.0) / 10]

    def score(self, clauses: list[tuple[str, float]]) -> float:
        if not self.coefficients:
            return 0.0
        z = self.intercept + sum(c * x for c, x in zip(self.coefficients, self.features(clauses)))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def _counts(sample: DataFrame) -> DataFrame:
    """term, toxic, n: of how many texts of the sample."""
    ddl = "term string, toxic int, n long"
    schema = arrow_schema(sample.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tally: Counter = Counter()
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tally.update((t, toxic) for t in set(itertools.chain.from_iterable(map(terms, set(_WORDS.findall(text.lower()))))))
            yield pa.RecordBatch.from_pydict({"term": [k[0] for k in tally], "toxic": [k[1] for k in tally], "n": list(tally.values())}, schema=schema)

    return sample.select("text", "toxic").mapInArrow(run, ddl).groupBy("term").pivot("toxic", [0, 1]).agg(F.sum("n")).na.fill(0)


def _contexts(sample: DataFrame, candidates: set[str]) -> DataFrame:
    """term, contexts: between how many different pairs of neighbours it stands."""
    shared = sample.sparkSession.sparkContext.broadcast(candidates)
    schema = arrow_schema(sample.sparkSession, "term string, context string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = set()
            for text in b.column(0).to_pylist():
                words = ["", *_WORDS.findall(text.lower()), ""]
                for left, word, right in zip(words, words[1:], words[2:]):
                    seen.update((t, f"{left} {right}") for t in terms(word) if t in shared.value)
            yield pa.RecordBatch.from_pydict({"term": [k[0] for k in seen], "context": [k[1] for k in seen]}, schema=schema)

    found = sample.where("toxic = 1").select("text").mapInArrow(run, "term string, context string")
    return found.distinct().groupBy("term").agg(F.count("*").alias("contexts"))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 10_000, max_terms: int = 20_000, seed: int = 7) -> ToxicityModel:
    """Learn from the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) marks."""
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect() if r["toxic"] in (0, 1)}
    if len(n) < 2:
        return ToxicityModel()
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = F.when(F.col("toxic") == 1, min(1.0, per_class / n[1])).otherwise(min(1.0, per_class / n[0]))
    marks = marks.where(F.col("toxic").isin(0, 1) & (draw < share))
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL").join(F.broadcast(marks), "doc_id")  # 2 * per_class small rows
    sample = cut(found.groupBy(F.sha2("text", 256).alias("key")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")))  # copies count once
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return ToxicityModel()
    both, weight = size[0] + size[1], F.log((F.col("1") + 0.5) / (size[1] + 1)) - F.log((F.col("0") + 0.5) / (size[0] + 1))

    def evidence(n1: Column, n0: Column) -> Column:
        """Log likelihood ratio of the term's own share of toxic texts to the overall one."""
        part = lambda n, size: F.when(n > 0, n * F.log(n / ((n1 + n0) * (size / both)))).otherwise(0.0)
        return part(n1, size[1]) + part(n0, size[0])

    counts = cut(_counts(sample))
    enough = math.log(max(2, counts.count()))  # less than one term of all would reach it by chance
    likely = counts.withColumn("weight", weight).where((F.col("weight") >= math.log(RATIO)) & (evidence(F.col("1"), F.col("0")) >= enough))
    likely = cut(likely.orderBy(F.desc("weight"), "term").limit(max_terms))
    named = {r["term"] for r in likely.select("term").collect()}
    found = likely.join(_contexts(sample, named), "term").where(evidence(F.least("1", "contexts"), F.col("0")) >= enough)
    model = ToxicityModel({r["term"]: r["weight"] for r in found.select("term", "weight").collect()})
    schema = arrow_schema(docs.sparkSession, "label double, x array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"label": list(map(float, b.column(1).to_pylist())), "x": [model.features(model.clauses(t)) for t in b.column(0).to_pylist()]}, schema=schema)

    rows = cut(sample.select("text", "toxic").mapInArrow(run, "label double, x array<double>")).select("label", array_to_vector("x").alias("features"))
    m = LogisticRegression(regParam=1e-3, maxIter=50).fit(rows)
    model.coefficients, model.intercept = tuple(map(float, np.asarray(m.coefficients))), float(m.intercept)
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score (0 to 1), clauses (text and score of each matched clause) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ddl = "doc_id long, score double, clauses array<struct<clause: string, score: double>>"
    schema = arrow_schema(docs.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = shared.value
            found = [m.clauses(t) for t in b.column(1).to_pylist()]
            named = [[{"clause": c, "score": s} for c, s in own] for own in found]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "score": list(map(m.score, found)), "clauses": named}, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ddl)
