"""Periodic runs of words, found with a run-length grammar built by recompression.

A run is a stretch of consecutive words with smallest period q and at least
``max(least, 2 q)`` words that no neighbouring word extends keeping period q.

* *Recompression.*  The words of many documents, with a separator of its own
  after each, are one sequence of numbers.  Rounds alternate block compression
  (a^k becomes the symbol (a, k)) and pair compression (the letters are split in
  two classes by a hash; every left letter followed by a right one becomes a pair
  symbol) until every document is one symbol.  Equal stretches are compressed
  alike but for their ends, and the levels shrink geometrically.
* *Extensions.*  How far two places agree, to the right or the left, is answered
  on the levels: both places climb while their symbols agree and their blocks
  start together; at a difference they go down again, and every level adds at
  most one letter or one part of a block.  No suffix array is built.
* *Candidates.*  A run of period q holds ``max(q, least - q)`` consecutive places
  that agree with the place q further on, so one of them is a multiple of that
  step: for every q the multiples are compared with the place q further on, and
  those that agree are extended to both sides.  There are n ln n such places.
  A stretch found for several periods belongs to the smallest.

Documents are taken in lots of about 200,000 words; a longer document is a lot
of its own.  Memory is about 100 bytes a word of a lot.  There is no shuffle.

Defined results
* words are runs of anything but [\\x20\\x09-\\x0D]; null and empty texts have none, no runs and an empty rest;
* a row of the result for every row of the input, repeated and null ids included;
* runs may overlap; they are listed by start, then period;
* an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmint.llm._util import arrow_schema, text_bytes

#: Words of a lot and compared places of a step.
LOT, STEP = 200_000, 2_000_000
DDL = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"


class Grammar:
    """The levels of a sequence whose separators (numbers from ``separators`` on) are all different.

    ``symbols[l]`` are the letters of level l, ``block[l]`` says in which letter
    of level l + 1 each lies, and ``first[l]`` where the letters of level l + 1 start in it.
    """

    def __init__(self, sequence: np.ndarray, separators: int):
        self.symbols = [sequence.astype(np.int32)]
        self.block: list[np.ndarray] = []
        self.first: list[np.ndarray] = []
        self.paired: list[bool] = []
        self._fixed = separators, int(sequence.max(initial=0)) + 1
        self._next = self._fixed[1]
        turn = 0
        while self._blocks() + self._pairs(turn):
            turn += 1

    def _add(self, first: np.ndarray, letters: np.ndarray, named: np.ndarray, keys: np.ndarray, paired: bool) -> None:
        names, of = np.unique(keys, return_inverse=True)
        letters[named] = self._next + of
        self._next += len(names)
        size = len(self.symbols[-1])
        self.first.append(np.append(first, size).astype(np.int32))
        self.block.append(np.repeat(np.arange(len(first), dtype=np.int32), np.diff(self.first[-1])))
        self.symbols.append(letters)
        self.paired.append(paired)

    def _blocks(self) -> bool:
        s = self.symbols[-1]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        if len(first) == len(s):
            return False
        sizes = np.diff(np.append(first, len(s)))
        letters, named = s[first], sizes > 1
        self._add(first, letters, named, letters[named].astype(np.int64) * (len(s) + 1) + sizes[named], False)
        return True

    def _pairs(self, turn: int) -> bool:
        """True as long as two letters of a document stand side by side, whether this turn's classes pair them or not."""
        s = self.symbols[-1]
        free = (s < self._fixed[0]) | (s >= self._fixed[1])
        beside = free[:-1] & free[1:]
        if not beside.any():
            return False
        mixed = (s.astype(np.uint64) + np.uint64(turn + 1)) * np.uint64(0x9E3779B97F4A7C15)
        right = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40) & np.uint64(1)).astype(bool)
        up, down = beside & ~right[:-1] & right[1:], beside & right[:-1] & ~right[1:]
        pair = up if np.count_nonzero(up) >= np.count_nonzero(down) else down
        if pair.any():
            first = np.flatnonzero(np.concatenate([[True], ~pair]))
            letters, named = s[first], np.append(pair, False)[first]
            at = first[named]
            self._add(first, letters, named, s[at].astype(np.int64) * self._next + s[at + 1], True)
        return True

    def agree(self, x: np.ndarray, y: np.ndarray, back: bool = False) -> np.ndarray:
        """How many letters from ``x`` and ``y`` on (``back``: up to and with them, leftwards) are the same; x != y, no separators between."""
        way = -1 if back else 1
        begin, who = x, np.arange(len(x))
        stopped: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def rest(first: np.ndarray, block: np.ndarray, at: np.ndarray) -> np.ndarray:
            return at - first[block] + 1 if back else first[block + 1] - at

        for s, block, first in zip(self.symbols, self.block, self.first):
            same = s[x] == s[y]
            lost = [(who[~same], x[~same], y[~same])]
            who, x, y = who[same], x[same], y[same]
            bx, by = block[x].astype(np.int64), block[y].astype(np.int64)
            head = 1 if back else 0
            together = (first[bx + head] - head == x) & (first[by + head] - head == y)
            rx, ry = rest(first, bx, x), rest(first, by, y)
            ends = ~together & (rx != ry)  # the shorter rest of a block is followed by another letter
            if ends.any():
                m = way * np.minimum(rx, ry)[ends]
                lost.append((who[ends], x[ends] + m, y[ends] + m))
            inside = way * (~together).astype(np.int64)
            who, x, y = who[~ends], (bx + inside)[~ends], (by + inside)[~ends]
            stopped.append(tuple(map(np.concatenate, zip(*lost))))
            if not len(who):
                break
        else:
            s = self.symbols[-1]
            while True:
                same = s[x] == s[y]
                if not same.any():
                    break
                x, y = x + way * same, y + way * same
        for level in range(len(stopped) - 1, -1, -1):
            s, block, first = self.symbols[level], self.block[level], self.first[level]
            if len(who):
                x, y = (first[x + 1].astype(np.int64) - 1, first[y + 1].astype(np.int64) - 1) if back else (first[x].astype(np.int64), first[y].astype(np.int64))
                same = s[x] == s[y]
                more = 1 if self.paired[level] else np.minimum(rest(first, block[x], x), rest(first, block[y], y))
                x, y = x + way * same * more, y + way * same * more
            w, a, b = stopped[level]
            who, x, y = np.concatenate([who, w]), np.concatenate([x, a]), np.concatenate([y, b])
        out = np.empty(len(begin), dtype=np.int64)
        out[who] = x
        return way * (out - begin)


def find_runs(sequence: np.ndarray, starts: np.ndarray, sizes: np.ndarray, separators: int, least: int) -> np.ndarray:
    """Rows (start, end, period) of all runs of the documents at ``starts`` in ``sequence``, each between separators, in order."""
    longest = sizes // 2 * (sizes >= least)
    if not longest.any():
        return np.empty((0, 3), dtype=np.int64)
    grammar = Grammar(sequence, separators)
    doc = np.repeat(np.arange(len(sizes)), longest)
    period = np.arange(1, len(doc) + 1) - np.repeat(np.cumsum(longest) - longest, longest)
    step = np.maximum(period, least - period)
    places = (sizes[doc] - 1 - period) // step + 1
    cuts = np.searchsorted(np.cumsum(places), np.arange(0, int(places.sum()), STEP), side="left")
    cuts = np.unique(np.append(cuts, len(doc)))
    found = [np.empty((0, 3), dtype=np.int64)]
    for a, b in zip(cuts, cuts[1:]):
        n, p = places[a:b], period[a:b]
        whose = np.repeat(np.arange(b - a), n)
        nth = np.arange(len(whose)) - np.repeat(np.cumsum(n) - n, n)
        at = starts[doc[a:b]][whose] + nth * step[a:b][whose]
        q = p[whose]
        agrees = np.flatnonzero(sequence[at] == sequence[at + q])
        if not len(agrees):
            continue
        at, q = at[agrees], q[agrees]
        end = at + q + grammar.agree(at, at + q)
        begin = at + 1 - grammar.agree(at, at + q, back=True)
        fits = end - begin >= np.maximum(least, 2 * q)
        found.append(np.unique(np.stack([begin, end, q], axis=1)[fits], axis=0))
    rows = np.unique(np.concatenate(found), axis=0)  # by start, end, period
    return rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])] if len(rows) else rows


def _lot(texts: list[list[bytes]], least: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Runs (document, start, length, period) and what is left of each document."""
    sizes = np.array(list(map(len, texts)), dtype=np.int64)
    starts = np.cumsum(sizes + 1) - sizes
    codes = pa.array(list(chain.from_iterable(texts)), pa.binary()).dictionary_encode()
    sequence = np.zeros(int(sizes.sum()) + len(texts) + 1, dtype=np.int64)
    word = np.ones(len(sequence), dtype=bool)
    word[np.append(starts - 1, len(sequence) - 1)] = False
    known = len(codes.dictionary)
    sequence[word] = codes.indices.to_numpy(zero_copy_only=False)
    sequence[~word] = known + np.arange(len(texts) + 1)
    rows = find_runs(sequence, starts, sizes, known, least)
    dropped = np.zeros(len(sequence) + 1, dtype=np.int64)
    np.add.at(dropped, rows[:, 0] + rows[:, 2], 1)
    np.add.at(dropped, rows[:, 1], -1)
    kept = np.cumsum(dropped) == 0
    doc = np.searchsorted(starts, rows[:, 0], side="right") - 1
    out = np.stack([doc, rows[:, 0] - starts[doc], rows[:, 1] - rows[:, 0], rows[:, 2]], axis=1)
    touched = set(doc.tolist())
    rest = [b" ".join(compress(t, kept[s:s + len(t)].tolist()) if k in touched else t) for k, (t, s) in enumerate(zip(texts, starts.tolist()))]
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))], sizes, rest


def periodic_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words) and collapsed (UTF-8: the words that no run repeats, joined by a space) of every row."""
    if least < 2:
        raise ValueError("a run has two words at least")
    schema = arrow_schema(docs.sparkSession, DDL)

    def result(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        rows, sizes, rest = _lot(texts, least)
        ends = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1)).astype(np.int32)
        parts = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in (1, 2, 3)], fields=list(schema.field("runs").type.value_type))
        runs = pa.ListArray.from_arrays(pa.array(ends), parts, type=schema.field("runs").type)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), runs, pa.array(rest, pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids: list = []
            texts: list[list[bytes]] = []
            size = 0
            for i, text in zip(b.column(0), b.column(1)):
                ids.append(i.as_py())
                texts.append((text.as_py() or b"").split())
                size += len(texts[-1])
                if size >= LOT:
                    yield result(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield result(ids, texts)

    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(run, DDL)


def planted(doc_id: Column, text: Column) -> Column:
    """The text with its words from place a on repeated with period p, by the id's checksum h: where h % 10 = 0 (null ids: never)."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def changed(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    # The words are bound to a variable, so that they are not cut out of the text again for every place.
    once = F.get(F.transform(F.array(words), changed), 0)
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), once).otherwise(text)


def runs_digest(found: DataFrame) -> DataFrame:
    """The longest run (ties: smallest start, then period) and the digests of every row of :func:`periodic_runs`."""
    best = F.expr("array_min(transform(runs, r -> named_struct('shorter', -r.length, 'start', r.start, 'period', r.period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    row = found.withColumn("best", best)
    return row.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.shorter")).alias("length"),
        F.col("best.period").alias("period"), F.expr("(-1000 * best.shorter) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
