"""Language-model scoring over a subword lattice.

A document is its words (A-Z in lower case) and an end.  A word's lattice has
an arc for every piece of an existing byte-level vocabulary that spells a part
of it (with a blank before the word) and one arc for the word as a whole; the
score of a word is the marginal over all segmentations, by the forward
recursion in log space.  Pieces are a unigram model: their scores start from
the ranks of the vocabulary and are re-estimated from all training words by
expectations over all segmentations (``ROUNDS`` forward-backward passes).
Whole-word arcs carry the word's discounted count; what the discount frees
weighs the spelling.  A document's probability sums over classes (languages
with at least ``CLASS_SHARE`` of the training documents, and the rest), each
with its own scores; its class is never an input of the score.

Words are never shuffled document by document: a task packs whole documents
into blocks of about ``BLOCK_TOKENS`` tokens, each with a table of its distinct
words.  Only those tables are counted, joined with the corpus counts and brought
back to their block.

Defined results
* null text counts as empty: one token, the end; without training documents the
  base score is 0 and a word's score is that of its spelling;
* one row per row of the input, repeated and null ids included;
* an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmint.llm._util import arrow_schema, cut, text_bytes
from segmint.llm.bpe import read_ranks
from segmint.llm.hashing import HashTable

BLOCK_TOKENS = 4_000_000
CLASS_SHARE, ROUNDS, PRIOR = 0.01, 2, 1000.0
#: Words that a task handles at once.
WORDS_AT_ONCE = 1 << 16
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
LOG10 = math.log(10)


class Vocabulary:
    """The pieces (bytes) with a hash table from a piece's polynomial hash to its id."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = [t for t in tokens if t and b" " not in t[1:]]
        self.starts = np.array([t[:1] == b" " for t in self.tokens])
        with np.errstate(over="ignore"):
            keys = np.zeros(len(self.tokens), dtype=np.uint64)
            for i, t in enumerate(self.tokens):
                h = np.uint64(0)
                for c in t:
                    h = h * _P + np.uint64(c + 1)
                keys[i] = h
        self.longest = max(map(len, self.tokens))
        self.table = HashTable(keys.view(np.int64), np.arange(len(self.tokens), dtype=np.int32))

    def initial(self) -> np.ndarray:
        """Shares from the ranks, one distribution for first pieces and one for the others."""
        p = 1.0 / (np.arange(len(self.tokens)) + 10.0)
        return np.where(self.starts, p / p[self.starts].sum(), p / p[~self.starts].sum())

    def spans(self, words: list[bytes]) -> list[np.ndarray]:
        """Of n words of one length m: ids[l - 1][i] (n ids) of the pieces of length l that start at byte i, -1 where there is none."""
        a = np.ascontiguousarray(np.frombuffer(b"".join(words), dtype=np.uint8).reshape(len(words), -1).T).astype(np.uint64) + np.uint64(1)
        ids, h = [], np.zeros(a.shape, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for length in range(1, min(len(a), self.longest) + 1):
                h = h[: len(a) - length + 1] * _P + a[length - 1:]
                ids.append(self.table.get(h.view(np.int64), -1))
        return ids


def _sum_exp(xs: list[np.ndarray]) -> np.ndarray:
    x = np.stack(xs)
    top = x.max(axis=0)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=0)) + top


def forward(ids: list[np.ndarray], logp: np.ndarray) -> list[np.ndarray]:
    """alpha[j]: log probability of all ways to spell the first j bytes.  ``logp`` ends with -inf for id -1."""
    m, n = ids[0].shape
    alpha = [np.zeros(n)]
    for j in range(1, m + 1):
        alpha.append(_sum_exp([alpha[j - k] + logp[ids[k - 1][j - k]] for k in range(1, min(j, len(ids)) + 1)]))
    return alpha


def expected(ids: list[np.ndarray], logp: np.ndarray) -> np.ndarray:
    """Expected number of each piece over all segmentations of all words."""
    alpha, (m, n) = forward(ids, logp), ids[0].shape
    beta = [np.zeros(n)] * (m + 1)
    for i in range(m - 1, -1, -1):
        beta[i] = _sum_exp([beta[i + k] + logp[ids[k - 1][i]] for k in range(1, min(m - i, len(ids)) + 1)])
    out = np.zeros(len(logp))
    for k, own in enumerate(ids, 1):
        i, w = np.nonzero(own >= 0)
        piece = own[i, w]
        if len(i):
            a, b = np.stack(alpha[: m - k + 1]), np.stack(beta[k:])
            out += np.bincount(piece, weights=np.exp(a[i, w] + logp[piece] + b[i, w] - alpha[m][w]), minlength=len(logp))
    return out[:-1]


def by_length(words: list[bytes], longest: int = 24) -> Iterator[tuple[list[int], list[bytes]]]:
    """Places and texts (a blank before each) of the words of each length, in lots bounded for pieces of at most ``longest`` bytes."""
    lots: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        lots.setdefault(len(w), []).append(i)
    for m, at in sorted(lots.items()):
        step = max(1, min(20_000, (1 << 22) // ((m + 1) * min(m + 1, longest))))
        for k in range(0, len(at), step):
            yield at[k:k + step], [b" " + words[i] for i in at[k:k + step]]


@dataclass
class LatticeModel:
    """Its size: pieces of the vocabulary times classes."""

    tokens: list[bytes]
    logp: np.ndarray  # classes x (pieces + 1), natural log, the stop and go weights included
    priors: np.ndarray  # log share of each class
    end: np.ndarray  # log probability of the end
    go: np.ndarray  # log probability of another word
    words: np.ndarray  # number of words of each class
    discount: np.ndarray
    spelt: np.ndarray  # log weight of the spelling
    n_tokens: int = 0  # N and V of the base score
    n_distinct: int = 0
    end_count: int = 0

    def word_scores(self, vocabulary: Vocabulary, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Log probability of each word (rows) in each class; ``counts``: words x classes."""
        out = np.empty((len(words), len(self.priors)))
        for at, own in by_length(words, vocabulary.longest):
            ids = vocabulary.spans(own)
            for c in range(len(self.priors)):
                spelt = forward(ids, self.logp[c])[-1] + self.spelt[c]
                with np.errstate(divide="ignore"):
                    whole = np.log(np.maximum(counts[at, c] - self.discount[c], 0) / max(1.0, self.words[c]))
                out[at, c] = np.logaddexp(whole, spelt) + self.go[c]
        return out


_made: dict[bytes, Vocabulary] = {}
_last: list = [None, None]  # the list asked for last, and its vocabulary


def _vocabulary(tokens: list[bytes]) -> Vocabulary:
    """The worker's vocabulary of these very tokens, kept by a digest of all of them."""
    if _last[0] is not tokens:
        key = hashlib.sha256(repr(tokens).encode()).digest()
        if key not in _made:
            _made.clear()
            _made[key] = Vocabulary(tokens)
        _last[:] = tokens, _made[key]
    return _last[1]


def _weights(counts: np.ndarray, starts: np.ndarray, initial: np.ndarray) -> np.ndarray:
    """Log scores of the pieces from expected counts: first pieces carry the stop, the others the going on."""
    first, more = counts[starts].sum() + 1.0, counts[~starts].sum() + 1.0
    stop = first / (first + more)
    p = (counts + PRIOR * initial) / np.where(starts, counts[starts].sum() + PRIOR, counts[~starts].sum() + PRIOR)
    return np.append(np.log(p) + np.where(starts, math.log(stop), math.log1p(-stop)), -np.inf)


def _blocks(docs: DataFrame, classes: list[str], block_tokens: int) -> DataFrame:
    """Rows of two kinds: a block's distinct words with their counts in training documents by class; its documents as bags of places."""
    counts = ", ".join(f"c{k} long" for k in range(len(classes) + 1))
    ddl = f"block long, place int, word binary, {counts}, doc_id long, held_out boolean, n_words long, bag binary"
    schema = arrow_schema(docs.sparkSession, ddl)
    of = {n: k for k, n in enumerate(classes)}
    nc = len(classes) + 1

    def give(block: int, places: dict[bytes, int], counts: list[np.ndarray], rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        def batch(n: int, cols: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([cols.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

        words = list(places)
        for k in range(0, len(words), 1 << 15):
            own = words[k:k + (1 << 15)]
            yield batch(len(own), {"block": pa.array([block] * len(own), pa.int64()), "place": pa.array(range(k, k + len(own)), pa.int32()), "word": pa.array(own, pa.binary())}
                        | {f"c{c}": pa.array(v[k:k + len(own)]) for c, v in enumerate(counts)})
        for k in range(0, len(rows), 1 << 10):
            own = list(zip(*rows[k:k + (1 << 10)]))
            yield batch(len(own[0]), {"block": pa.array([block] * len(own[0]), pa.int64()), "doc_id": pa.array(own[0], pa.int64()), "held_out": pa.array(own[1], pa.bool_()),
                                      "n_words": pa.array(own[2], pa.int64()), "bag": pa.array(own[3], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24  # the table is written, so a block's number holds
        places, counts, rows, size = {}, [], [], 0
        for b in batches:
            for doc_id, text, lang, held in zip(*(c.to_pylist() for c in b.columns)):
                words = text.lower().split()
                bag = Counter(words)
                own = np.fromiter((places.setdefault(w, len(places)) for w in bag), dtype=np.int64, count=len(bag))
                tf = np.fromiter(bag.values(), dtype=np.int64, count=len(bag))
                if not held:
                    counts.append((of.get(lang, nc - 1), own, tf))
                order = np.argsort(own)
                packed = np.diff(own[order], prepend=0).astype("<u4").tobytes() + tf[order].astype("<u4").tobytes()
                rows.append((doc_id, held, len(words), zlib.compress(packed, 1)))
                size += len(words) + 1
                if size >= block_tokens:
                    yield from give(block, places, _totals(counts, nc, len(places)), rows)
                    block, places, counts, rows, size = block + 1, {}, [], [], 0
        if rows:
            yield from give(block, places, _totals(counts, nc, len(places)), rows)

    return docs.mapInArrow(run, ddl)


def _totals(counts: list[tuple], classes: int, n: int) -> list[np.ndarray]:
    out = [np.zeros(n, dtype=np.int64) for _ in range(classes)]
    for c, own, tf in counts:
        out[c][own] += tf
    return out


def _reestimate(words: DataFrame, tokens: list[bytes], logp: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces by class over all distinct words that the class has."""
    classes, shared = len(logp), words.sparkSession.sparkContext.broadcast((tokens, logp))
    ddl = "class int, piece int, n double"
    schema = arrow_schema(words.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, logp = shared.value
        v = _vocabulary(tokens)
        total = np.zeros((classes, len(v.tokens)))
        for own, counts in _lots(batches, classes):
            for c in range(classes):
                for _, texts in by_length([own[i] for i in np.flatnonzero(counts[:, c] > 0)], v.longest):
                    total[c] += expected(v.spans(texts), logp[c])
        c, p = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(p, pa.int32()), pa.array(total[c, p])], schema=schema)

    found = words.select("word", *[f"c{k}" for k in range(classes)]).mapInArrow(run, ddl).groupBy("class", "piece").agg(F.sum("n").alias("n"))
    out = np.zeros((classes, len(_vocabulary(tokens).tokens)))
    got = found.toPandas()  # pieces x classes at most
    out[got["class"], got["piece"]] = got["n"]
    return out


def _lots(batches: Iterator[pa.RecordBatch], classes: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= WORDS_AT_ONCE:
            yield _lot(held, classes)
            held = []
    if held:
        yield _lot(held, classes)


def _lot(held: list[pa.RecordBatch], classes: int) -> tuple[list[bytes], np.ndarray]:
    t = pa.Table.from_batches(held)
    return t.column(0).to_pylist(), np.stack([t.column(k + 1).to_numpy() for k in range(classes)], axis=1)


def score_documents(docs: DataFrame, held_out: Column, vocabulary: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs`` (doc_id, text, lang).

    The model learns from the rows where ``held_out`` is false.  Scores are log10.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(), F.col("lang").cast("string").alias("lang"), F.coalesce(held_out, F.lit(False)).alias("held"))
    # Class sizes first, from the small columns alone.
    train = rows.where("NOT held").groupBy("lang").agg(F.count("*").alias("n"))
    n_train = int(train.agg(F.sum("n")).first()[0] or 0)
    large = {r["lang"]: r["n"] for r in train.where(F.col("lang").isNotNull() & (F.col("n") >= max(1, CLASS_SHARE * n_train))).collect()}  # 1 / CLASS_SHARE at most
    classes = sorted(large)
    docs_of = np.array([large[n] for n in classes] + [n_train - sum(large.values())], dtype=float)
    nc = len(classes) + 1
    cs = [f"c{k}" for k in range(nc)]
    packed = cut(_blocks(rows, classes, block_tokens))
    places = packed.where("word IS NOT NULL").select("block", "place", "word", *cs)
    words = cut(places.groupBy("word").agg(*[F.sum(c).alias(c) for c in cs]))
    stats = words.agg(F.count(F.when(sum((F.col(c) for c in cs), F.lit(0)) > 0, 1)).alias("v"),
                      *[f(c, k) for k, c in enumerate(cs) for f in (lambda c, k: F.coalesce(F.sum(c), F.lit(0)).alias(f"n{k}"), lambda c, k: F.count(F.when(F.col(c) > 0, 1)).alias(f"v{k}"),
                                                                    lambda c, k: F.count(F.when(F.col(c) == 1, 1)).alias(f"one{k}"), lambda c, k: F.count(F.when(F.col(c) == 2, 1)).alias(f"two{k}"))]).first()
    total, distinct, one, two = (np.array([stats[f"{n}{k}"] for k in range(nc)], dtype=float) for n in ("n", "v", "one", "two"))
    tokens = read_ranks(vocabulary)
    v = _vocabulary(tokens)
    initial = v.initial()
    logp = np.stack([_weights(np.zeros(len(initial)), v.starts, initial)] * nc)
    for _ in range(ROUNDS):
        counts = _reestimate(words, tokens, logp)
        logp = np.stack([_weights(own, v.starts, initial) for own in counts])
    discount = np.where(one + two > 0, np.clip(one / np.maximum(1, one + 2 * two), 0.1, 0.95), 0.5)
    end = (docs_of + 1) / (total + docs_of + 2)
    with np.errstate(divide="ignore"):
        model = LatticeModel(tokens, logp, np.log(docs_of / n_train) if n_train else np.append(np.full(nc - 1, -np.inf), 0.0), np.log(end), np.log1p(-end), total, discount,
                             np.log(np.where(total > 0, discount * distinct / np.maximum(1, total), 1.0)), int(total.sum()) + n_train, int(stats["v"]) + (n_train > 0), n_train)
    shared = spark.sparkContext.broadcast(model)
    ddl = "word binary, n long, scores array<float>"
    schema = arrow_schema(spark, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for own, counts in _lots(batches, nc):
            scores = m.word_scores(_vocabulary(m.tokens), own, counts).astype(np.float32)
            for k in range(0, len(own), 1 << 14):
                part = scores[k:k + (1 << 14)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * nc), pa.array(part.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(own[k:k + (1 << 14)], pa.binary()), pa.array(counts[k:k + (1 << 14)].sum(axis=1)), lists], schema=schema)

    scored = words.select("word", *cs).mapInArrow(run, ddl)
    back = places.select("block", "place", "word").join(scored, "word").select("block", "place", "n", "scores")
    own = packed.where("bag IS NOT NULL").select(F.col("block").alias("of"), "doc_id", "held_out", "n_words", "bag")
    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out_schema = arrow_schema(spark, ddl)

    def block(table: pa.Table, bags: pa.Table) -> pa.Table:
        m, size = shared.value, table.num_rows
        at = table.column("place").to_numpy()
        n, lp = np.zeros(size, dtype=np.int64), np.zeros((size, nc))
        n[at] = table.column("n").to_numpy()
        if size:
            lp[at] = table.column("scores").combine_chunks().flatten().to_numpy().reshape(-1, nc)
        norm = math.log10(m.n_tokens + 0.1 * (m.n_distinct + 1))
        base = np.log10(n + 0.1) - norm
        out = {f.name: [] for f in out_schema}
        for i, held, n_words, bag in zip(*(bags.column(c).to_pylist() for c in ("doc_id", "held_out", "n_words", "bag"))):
            raw = np.frombuffer(zlib.decompress(bag), dtype="<u4").astype(np.int64)
            place, tf = raw[:len(raw) // 2].cumsum(), raw[len(raw) // 2:]
            z = m.priors + m.end + tf @ lp[place]
            top = z.max()
            for c, value in zip(out.values(), (i, held, n_words + 1, int(tf[n[place] > 0].sum()) + (m.end_count > 0), m.n_tokens,
                                               float(tf @ base[place]) + math.log10(m.end_count + 0.1) - norm, (top + math.log(np.exp(z - top).sum())) / LOG10)):
                c.append(value)
        return pa.Table.from_pydict(out, schema=out_schema)

    return back.groupBy("block").cogroup(own.groupBy("of")).applyInArrow(block, ddl)
