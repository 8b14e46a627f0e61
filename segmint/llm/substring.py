"""Substring dedup by automata over recurring phrases.

A window is ``SPAN`` consecutive words (between ASCII blanks, unchanged) of one
document; a word goes if a window over it also starts in a document with a
smaller doc_id.

1. Anchors.  Every window is stood for by the least hash among its grams of
   ``GRAM`` words, so equal windows have equal anchors.  An anchor of two different
   texts marks recurring windows.
2. Confirmation.  Windows with such an anchor are compared by their own hash; each
   names the first document that has it, or any earlier one.  Both steps settle
   what they can within a pack of documents and shuffle one row of a pack for a
   value, so a passage that a third of all documents share is no hot key.
3. Automata.  The recurring windows of a document that others follow are compiled
   into Aho-Corasick automata over its words' numbers, in shards of at most
   ``SHARD`` windows; every follower's recurring passages stream through them, in
   lots of about ``LOT`` followers.  What they locate is equal word for word, so a hash
   that two texts share removes nothing.
4. Texts that are equal as word sequences need no automaton: all but those of the
   smallest doc_id lose every word, if they are long enough to hold a window.

Defined results
* null text counts as empty; a document with fewer than ``SPAN`` words keeps all;
* rows with the same doc_id never remove from each other; a null doc_id is larger
  than any other; repeated rows get the same result, a row each;
* an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmint.llm._util import arrow_schema, cut, map_arrow

SPAN, GRAM = 13, 6
#: Windows of an automaton, followers that stream through one, values settled together in a task: bounds of memory and of a task's work only.
SHARD, LOT, PACK = 50_000, 1_000, 1_000_000
LAST = (1 << 63) - 1
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n words in a row."""
    if len(h) < n:
        return h[:0]
    a = np.zeros(len(h) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            a = a * _MUL + h[j:len(h) - n + 1 + j]
        a ^= a >> np.uint64(31)
        a *= np.uint64(0xBF58476D1CE4E5B9)
        return a ^ (a >> np.uint64(29))


def anchors(h: np.ndarray, span: int, gram: int) -> np.ndarray:
    """The least gram hash of every window."""
    g, width, have = _grams(h, gram), span - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        g = np.minimum(g[:-step], g[step:]) if len(g) > step else g[:0]
        have += step
    return g


def _packs(batches: Iterator[pa.RecordBatch], values: Callable[[pa.RecordBatch], tuple[np.ndarray, ...]], settle: Callable[..., Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Values of several batches settled together."""
    held: list[tuple[np.ndarray, ...]] = []
    for whole in batches:
        for k in range(0, whole.num_rows, 256):
            held.append(values(whole.slice(k, 256)))
            if sum(len(x[0]) for x in held) >= PACK:
                yield from settle(*map(np.concatenate, zip(*held)))
                held = []
    if held:
        yield from settle(*map(np.concatenate, zip(*held)))


def _runs(batches: Iterator[pa.RecordBatch], of: Callable[..., Iterator[pa.RecordBatch]], done: Callable[[pa.RecordBatch], pa.Array]) -> Iterator[pa.RecordBatch]:
    """Rows that are ``done`` as they are, and what ``of`` makes of whole runs of the first column (sorted; a run has a few rows of a pack at most)."""
    held: list[np.ndarray] | None = None
    for b in itertools.chain(batches, [None]):
        if b is not None:
            ready = done(b)
            if (out := b.filter(ready)).num_rows:
                yield out
            new = [c.to_numpy(zero_copy_only=False) for c in b.filter(pc.invert(ready)).columns]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        if held is None or not len(held[0]):
            continue
        upto = len(held[0]) if b is None else int(np.searchsorted(held[0], held[0][-1]))
        if upto:
            yield from of(*(c[:upto] for c in held))
            held = [c[upto:] for c in held]


def _firsts(v: np.ndarray) -> np.ndarray:
    """For each place of a sorted array the place where its run starts."""
    new = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    return np.repeat(new, np.diff(np.append(new, len(v))))


def _dealt(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """One shuffle by ``key``, then sorted."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, key).sortWithinPartitions(*order)


def _recurring_anchors(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """tkey, vs: the anchors of a text that another text has too."""
    ddl = "v long, tkey long, known boolean"
    schema = arrow_schema(docs.sparkSession, ddl)

    def values(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        vs, ks = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
        for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            a = anchors(_word_hashes(t.split()), span, gram)
            a = a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a
            vs.append(a)
            ks.append(np.full(len(a), k, dtype=np.int64))
        return np.concatenate(vs).view(np.int64), np.concatenate(ks)

    def batch(v: np.ndarray, k: np.ndarray, known: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v), pa.array(k), pa.array(np.full(len(v), known))], schema=schema)

    def settle(v: np.ndarray, k: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((k, v))
        v, k = v[order], k[order]
        if len(v):
            once = np.concatenate([[True], (v[1:] != v[:-1]) | (k[1:] != k[:-1])])
            v, k = v[once], k[once]
            first = _firsts(v)
            more = np.bincount(first, minlength=len(v))[first] > 1
            one = first == np.arange(len(v))  # others learn of the value from this row
            for rows, known in ((more, True), (one, False)):
                by_text = np.flatnonzero(rows)[np.argsort(k[rows], kind="stable")]  # equal keys in a row pack well
                yield batch(v[by_text], k[by_text], known)

    def shared(v: np.ndarray, k: np.ndarray, known: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = _firsts(v)
        differs = np.zeros(len(v), dtype=bool)
        differs[first[k != k[first]]] = True
        hit = differs[first]
        if hit.any():
            yield batch(v[hit], k[hit], True)

    posted = docs.select("tkey", "text").mapInArrow(lambda bs: _packs(bs, values, settle), ddl)
    dealt = _dealt(posted, F.when(F.col("known"), F.col("tkey")).otherwise(F.col("v")), "known", "v", "tkey")
    return dealt.mapInArrow(lambda bs: _runs(bs, shared, lambda b: b.column(2)), ddl).groupBy("tkey").agg(F.collect_set("v").alias("vs"))


def _candidates(docs: DataFrame, recurring: DataFrame, span: int, gram: int) -> DataFrame:
    """doc_id, tkey, starts, passages: the recurring passages of a document - runs of windows whose anchor recurs, as
    words joined by a blank - and the word that each starts at."""
    ddl = "doc_id long, tkey long, starts array<int>, passages array<binary>"
    schema = arrow_schema(docs.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                starts, passages = [], []
                for t, vs in zip(b.column(2).to_pylist(), b.column(3)):
                    words = t.split()
                    hit = np.isin(anchors(_word_hashes(words), span, gram), vs.values.to_numpy().view(np.uint64))
                    edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
                    starts.append(np.flatnonzero(edge == 1))
                    passages.append([b" ".join(words[s:e + span - 1]) for s, e in zip(starts[-1], np.flatnonzero(edge == -1))])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(starts, schema.field(2).type), pa.array(passages, schema.field(3).type)], schema=schema)

    return docs.join(recurring, ["tkey", "doc_id"]).select("doc_id", "tkey", "text", "vs").mapInArrow(run, ddl)


def _followers(found: DataFrame, span: int) -> DataFrame:
    """doc_id, tkey, owner, okey: documents and an earlier one that has one of their windows, for every such window."""
    ddl = "h long, doc_id long, tkey long, owner long, okey long"
    schema = arrow_schema(found.sparkSession, ddl)

    def values(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        hs, ds, ks = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for d, k, passages in zip(*(c.to_pylist() for c in b.columns)):
            own = np.unique(np.concatenate([hs[0], *(_grams(_word_hashes(p.split()), span) for p in passages)]))
            hs.append(own)
            ds.append(np.full(len(own), d, dtype=np.int64))
            ks.append(np.full(len(own), k, dtype=np.int64))
        return np.concatenate(hs).view(np.int64), np.concatenate(ds), np.concatenate(ks)

    def pairs(h: np.ndarray, d: np.ndarray, k: np.ndarray, *_) -> Iterator[pa.RecordBatch]:
        first = _firsts(h)
        after = d > d[first]
        p = np.unique(np.stack([d[after], k[after], d[first][after], k[first][after]]), axis=1)
        if p.size:
            yield pa.RecordBatch.from_arrays([pa.nulls(p.shape[1], pa.int64()), *map(pa.array, p)], schema=schema)

    def settle(h: np.ndarray, d: np.ndarray, k: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((k, d, h))
        h, d, k = h[order], d[order], k[order]
        if len(h):
            yield from pairs(h, d, k)
            one = np.flatnonzero(d == d[_firsts(h)])  # the earliest of the pack; a still earlier one elsewhere becomes its owner
            one = one[np.lexsort((k[one], d[one]))]
            none = pa.nulls(len(one), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(h[one]), pa.array(d[one]), pa.array(k[one]), none, none], schema=schema)

    posted = found.select("doc_id", "tkey", "passages").mapInArrow(lambda bs: _packs(bs, values, settle), ddl)
    dealt = _dealt(posted, F.when(F.col("owner").isNull(), F.col("h")).otherwise(F.xxhash64("doc_id", "owner")), "owner", "h", "doc_id", "tkey")
    return dealt.mapInArrow(lambda bs: _runs(bs, pairs, lambda b: pc.is_valid(b.column(3))), ddl).drop("h").distinct()


class Automaton:
    """Windows of one document as sequences of word numbers."""

    def __init__(self, words: list[bytes], starts: list[int], ends: list[int], span: int, first: int, upto: int):
        self.numbers: dict[bytes, int] = {}
        self.span = span
        self.found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        at = 0
        for s, e in zip(starts, ends):
            a, b = max(s, s + first - at), min(e, s + upto - at)  # the windows number first to upto of all
            at += e - s
            if a < b:
                own = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words[a:b + span - 1])
                for i in range(b - a):
                    self.found.add_word(own[i:i + span])
        self.any = len(self.found) > 0
        if self.any:
            self.found.make_automaton()

    def locate(self, words: list[bytes]) -> list[int]:
        """Starts of the windows of ``words`` that the automaton holds."""
        if not self.any:
            return []
        return [end - self.span + 1 for end, _ in self.found.iter(tuple(self.numbers.get(w, 0) for w in words))]


def _located(found: DataFrame, followers: DataFrame, span: int, shard: int, lot: int) -> DataFrame:
    """doc_id, tkey, starts, ends: places of words (end excluded) that an earlier document has, per shard."""
    ddl = "doc_id long, tkey long, starts array<int>, ends array<int>"
    schema = arrow_schema(found.sparkSession, ddl)
    blanks = F.aggregate("passages", F.lit(0), lambda n, p: n + F.regexp_count(p.cast("string"), F.lit(" ")) + (2 - span))  # windows: words less span, plus one
    sizes = found.select(F.col("doc_id").alias("owner"), F.col("tkey").alias("okey"), F.ceil(blanks / shard).cast("int").alias("shards")).distinct()
    owners = followers.groupBy("owner", "okey").agg(F.ceil(F.count("*") / lot).cast("int").alias("lots")).join(sizes, ["owner", "okey"])
    shards = F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")
    compiled = owners.select(F.col("owner").alias("doc_id"), F.col("okey").alias("tkey"), "owner", "okey", shards, "lots").select(
        "doc_id", "tkey", "owner", "okey", "shard", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), F.lit(0).alias("kind"))
    streamed = followers.join(owners, ["owner", "okey"]).select(
        "doc_id", "tkey", "owner", "okey", shards, F.pmod(F.xxhash64("doc_id", "tkey"), F.col("lots")).cast("int").alias("lot"), F.lit(1).alias("kind"))
    passages = found.dropDuplicates(["doc_id", "tkey"])
    key = ["owner", "okey", "shard", "lot"]
    dealt = compiled.unionByName(streamed).join(passages, ["doc_id", "tkey"])
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, *key).sortWithinPartitions(*key, "kind").select(*key, "kind", "doc_id", "tkey", "starts", "passages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = None
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                out: list[tuple] = []
                for _, _, no, _, kind, doc, tkey, starts, texts in zip(*(c.to_pylist() for c in whole.slice(k, 256).columns)):
                    words = [t.split() for t in texts]
                    if kind == 0:
                        at = np.cumsum([0, *map(len, words)]).tolist()
                        automaton = Automaton(list(itertools.chain.from_iterable(words)), at[:-1], [a + len(w) - span + 1 for a, w in zip(at, words)], span, no * shard, (no + 1) * shard)
                        continue
                    spans = [(s + i, s + i + span) for s, w in zip(starts, words) for i in automaton.locate(w)]
                    if spans:
                        a, b = merged(np.array(spans))
                        out.append((doc, tkey, a, b))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return dealt.mapInArrow(run, ddl)


def merged(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans (start, end) as few spans apart from each other."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return spans[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, shard: int = SHARD, lot: int = LOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept (binary: the kept words joined by a blank; null where none is removed), kept_sha256,
    starts and ends of the removed words: a row for each row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(text).alias("tkey"), text.cast("binary").alias("text"))

    def whole(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": b["doc_id"], "tkey": b["tkey"], "n_words": [], "sha": []}
        for t in b["text"]:
            words = t.split()
            out["n_words"].append(len(words))
            out["sha"].append(hashlib.sha256(b" ".join(words)).hexdigest())
        return out

    base = cut(map_arrow(rows, whole, "doc_id long, tkey long, n_words long, sha string"))
    first = base.groupBy("sha").agg(F.min("doc_id").alias("first_id"))
    reps = base.where(F.col("n_words") >= span).groupBy("tkey").agg(F.min("doc_id").alias("doc_id"))
    recurring = _recurring_anchors(rows, span, gram).join(reps, "tkey")
    found = cut(_candidates(rows, recurring, span, gram))
    located = _located(found, cut(_followers(found, span)), span, shard, lot).groupBy("doc_id", "tkey").agg(
        F.flatten(F.collect_list("starts")).alias("cut_starts"), F.flatten(F.collect_list("ends")).alias("cut_ends"))

    def keep(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": b["doc_id"], "tkey": b["tkey"], "kept": [], "kept_sha": [], "n_removed": [], "starts": [], "ends": []}
        for t, s, e in zip(b["text"], b["cut_starts"], b["cut_ends"]):
            words = t.split()
            starts, ends = merged(np.stack([s, e], axis=1))
            kept = b" ".join(itertools.chain.from_iterable(words[a:z] for a, z in zip([0, *ends.tolist()], [*starts.tolist(), len(words)])))
            for c, v in zip(("kept", "kept_sha", "n_removed", "starts", "ends"), (kept, hashlib.sha256(kept).hexdigest(), int((ends - starts).sum()), starts, ends)):
                out[c].append(v)
        return out

    shortened = map_arrow(rows.select("doc_id", "tkey", "text").join(located, ["doc_id", "tkey"]), keep,
                          "doc_id long, tkey long, kept binary, kept_sha string, n_removed long, starts array<int>, ends array<int>").dropDuplicates(["doc_id", "tkey"])
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= span)
    joined = base.join(first, "sha").join(shortened, ["doc_id", "tkey"], "left")
    all_ = lambda one, other: F.when(copy, one).otherwise(other)
    return joined.select(F.nullif("doc_id", F.lit(LAST)).alias("doc_id"), "n_words", all_(F.col("n_words"), F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
                         all_(F.lit(b""), F.col("kept")).alias("kept"), all_(F.lit(hashlib.sha256(b"").hexdigest()), F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
                         all_(F.array(F.lit(0)), F.col("starts")).alias("starts"), all_(F.array(F.col("n_words").cast("int")), F.col("ends")).alias("ends"))
