"""SimHash near-dedup by a byte-position inverted index with count filtering.

A fingerprint is cut into its eight bytes.  Two fingerprints that differ in at
most d bits agree in at least ``8 - d`` byte positions (the guaranteed minimum
of matches).  Posting lists of a single position would hold 1/256 of all
fingerprints each, so a pair meets in lists keyed by a few positions at once:
``position_groups`` picks position sets such that every set of ``8 - d``
positions holds one of them (20 sets of three for d = 4).  Where two
fingerprints meet, their equal positions are tallied, pairs below the minimum
are dropped and the rest verified by their bit distance.

A list gives a spanning forest of its links, not its pairs: fingerprints within
d/2 bits of a pivot are joined to it at once, and only what may still join two
different parts is compared.  Lists longer than ``MOST`` go another exact
way: every fingerprint names all values within d/2 bits of it (in the bits that
the list leaves open), and two within d bits share one of them; such a value is
shared by as many fingerprints as there are such flips, at most.

Defined results
* null text counts as empty; a text without words has fingerprint zero;
* one row per row of the input; repeated rows link to each other (distance 0);
* null doc_ids are kept and link others, but never name a component unless it
  has no other id;
* an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmint.llm._util import arrow_schema, cut, map_arrow, text_bytes
from segmint.llm.graph import components

POSITIONS = 8
#: Fingerprints that one task may hold of a posting list (8 MB); longer lists go by shared neighbours, exactly.
MOST = 1 << 20
#: Lists up to SMALL are compared by offsets for all lists of a batch at once; above SPLIT a list is cut by one more position.
SMALL, SPLIT = 6, 2048


def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    """64-bit SimHash of UTF-8 bytes: A-Z in lower case, words between ASCII blanks, ``shingle`` words, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-shingle] + 1])
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, dtype=np.int64), len(starts)
    for k in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[k:k + (1 << 16)].tolist(), ends[shingle - 1:][k:k + (1 << 16)].tolist())], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, text_key (a hash of the text, to find the row again), fp (the 64 bits as a signed long)."""
    def rows(b: dict[str, list]) -> dict[str, list]:
        fps = [fingerprint(t, shingle, seed) for t in b["text"]]
        return {"doc_id": b["doc_id"], "text_key": b["text_key"], "fp": [f - (1 << 64) if f >> 63 else f for f in fps]}

    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), text_bytes()), rows, "doc_id long, text_key long, fp long")


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def position_groups(matches: int, size: int) -> list[tuple[int, ...]]:
    """Sets of ``size`` byte positions such that any ``matches`` positions hold one: three classes in a ring for
    (4, 3), which is known to be least; a greedy cover else."""
    if (matches, size) == (4, 3):
        ring = [p * 3 // POSITIONS for p in range(POSITIONS)]  # classes of 3, 3 and 2
        kinds = {(0, 0, 0), (1, 1, 1), (2, 2, 2), (0, 0, 1), (1, 1, 2), (0, 2, 2)}
        return [c for c in itertools.combinations(range(POSITIONS), 3) if tuple(sorted(ring[p] for p in c)) in kinds]
    left = set(itertools.combinations(range(POSITIONS), matches))
    found = []
    while left:
        best = max(itertools.combinations(range(POSITIONS), size), key=lambda c: sum(set(c) <= set(m) for m in left))
        found.append(best)
        left = {m for m in left if not set(best) <= set(m)}
    return found


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def matching(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many byte positions agree."""
    x = np.atleast_1d(a ^ b)
    return (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=-1)


def forest(x: np.ndarray, d: int) -> list[tuple[int, int]]:
    """Edges (indexes into x, distinct values) that join exactly what chains of links of at most d bits join."""
    part = np.full(len(x), -1)
    edges: list[tuple[int, int]] = []
    pivots: list[int] = []
    rest = np.arange(len(x))
    while len(rest):  # balls of d/2 bits: all inside are linked with each other
        p = int(rest[0])
        near = distance(x[rest], x[p]) <= d // 2
        ball = rest[near]
        part[ball] = len(pivots)
        edges += [(p, int(i)) for i in ball if i != p]
        pivots.append(p)
        rest = rest[~near]
    top = np.arange(len(pivots))  # the component of each ball, relabelled as balls join

    def join(k: int, a: np.ndarray, b: np.ndarray) -> None:
        """Add one link (a[i], b[i]) for each component among those of b, which then belong to ball k's."""
        found, one = np.unique(top[part[b]], return_index=True)
        edges.extend(zip(a[one].tolist(), b[one].tolist()))
        top[np.isin(top, found)] = top[k]

    for k, p in enumerate(pivots):
        far = np.flatnonzero(top[part] != top[k])
        if not len(far):
            break
        dist = distance(x[far], x[p])
        hit = far[dist <= d]
        hit = hit[matching(x[hit], x[p]) >= POSITIONS - d]
        if len(hit):
            join(k, np.full(len(hit), p), hit)
        far = far[(dist > d) & (dist <= d + d // 2)]  # only these can be within d bits of another one of the ball
        own = np.flatnonzero(part == k)
        step = max(1, (1 << 21) // len(own))
        while len(far := far[top[part[far]] != top[k]]):
            now, far = far[:step], far[step:]
            i, j = np.nonzero(distance(x[own][:, None], x[now][None, :]) <= d)
            if len(i):
                join(k, own[i], now[j])
    return edges


def list_edges(keys: np.ndarray, x: np.ndarray, groups: list[tuple[int, ...]], d: int) -> list[np.ndarray]:
    """Edges (pairs of fingerprints) of whole posting lists; ``keys`` is sorted."""
    out = []
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    length = np.diff(np.append(first, len(keys)))
    size = np.repeat(length, length)
    for s in range(1, SMALL):
        a = np.flatnonzero((keys[s:] == keys[:-s]) & (size[s:] <= SMALL)) if len(keys) > s else np.zeros(0, dtype=np.int64)
        if not len(a):
            break
        u, v = x[a], x[a + s]
        ok = matching(u, v) >= POSITIONS - d  # tally, then verify
        u, v = u[ok], v[ok]
        ok = distance(u, v) <= d
        out.append(np.stack([u[ok], v[ok]], axis=1))
    for at, n in zip(first[length > SMALL].tolist(), length[length > SMALL].tolist()):
        own = x[at:at + n]
        parts = [own]
        if n > SPLIT and len(groups[0]) < POSITIONS - d:  # a linked pair agrees in one position more
            parts = []
            for p in set(range(POSITIONS)) - set(groups[int(keys[at]) >> 40]):
                byte = (own >> np.uint64(8 * p)) & np.uint64(255)
                order = np.argsort(byte, kind="stable")
                parts += np.split(own[order], np.flatnonzero(np.diff(byte[order])) + 1)
        for sub in parts:
            if len(sub) > 1 and (e := forest(sub, d)):
                i = np.array(e)
                out.append(np.stack([sub[i[:, 0]], sub[i[:, 1]]], axis=1))
    return out


def links(fps: DataFrame, d: int = 4, most: int = MOST) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of ``fps`` (fp long, distinct) that join what links of at most d bits join."""
    matches = POSITIONS - d
    if not 1 <= matches:
        raise ValueError("the largest bit distance must be below 8")
    groups = position_groups(matches, min(max(1, matches - 1), 4))
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)) for p in range(POSITIONS)]
    keys = []
    for g, ps in enumerate(groups):  # the set's number, then its bytes
        k = F.lit(0).cast("long")
        for p in ps:
            k = F.shiftleft(k, 8).bitwiseOR(byte[p])
        keys.append(F.lit(g << 40).bitwiseOR(k))
    posted = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    long = cut(posted.groupBy("key").count().where(F.col("count") > most).select("key"))
    schema = arrow_schema(fps.sparkSession, "a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_x = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held_k = np.concatenate([held_k, b.column(0).to_numpy()])
                held_x = np.concatenate([held_x, b.column(1).to_numpy().astype(np.int64).view(np.uint64)])
                upto = int(np.searchsorted(held_k, held_k[-1])) if len(held_k) else 0  # the last list may go on
            else:
                upto = len(held_k)
            if upto:
                found = list_edges(held_k[:upto], held_x[:upto], groups, d)
                held_k, held_x = held_k[upto:], held_x[upto:]
                if found and len(e := np.concatenate(found).view(np.int64)):
                    yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], schema=schema)

    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    short = posted.join(long, "key", "left_anti").repartition(parts, "key").sortWithinPartitions("key", "fp")
    edges = short.select("key", "fp").mapInArrow(run, "a long, b long")
    if not long.isEmpty():
        edges = edges.unionByName(_by_neighbours(posted.join(long, "key", "left_semi"), groups, d))
    return edges.distinct()


def _by_neighbours(posted: DataFrame, groups: list[tuple[int, ...]], d: int) -> DataFrame:
    """Edges of very long lists.  Two within d bits share a value that one reaches by d/2 flips, rounded up, and the
    other by d/2, rounded down; all that reach a value by the former are joined to the least that does by the latter."""
    masks, flips = [], []
    for ps in groups:
        free = [b for b in range(64) if b // 8 not in ps]
        sets = [c for n in range((d + 1) // 2 + 1) for c in itertools.combinations(free, n)]
        masks.append(np.array([sum(1 << b for b in c) for c in sets], dtype=np.uint64).view(np.int64))
        flips.append(np.array([len(c) for c in sets], dtype=np.int32))

    def rows(b: dict[str, list]) -> dict[str, list]:
        key, x = np.array(b["key"], dtype=np.int64), np.array(b["fp"], dtype=np.int64)
        out: dict[str, list] = {"key": [], "fp": [], "value": [], "flips": []}
        for g in np.unique(key >> 40):
            own, m = np.flatnonzero(key >> 40 == g), masks[g]
            for c, v in zip(out.values(), (np.repeat(key[own], len(m)), np.repeat(x[own], len(m)), (x[own][:, None] ^ m).ravel(), np.tile(flips[g], len(own)))):
                c.append(v)
        return {n: np.concatenate(v) for n, v in out.items()}

    named = map_arrow(posted.select("key", "fp"), rows, "key long, fp long, value long, flips int")
    least = named.where(F.col("flips") <= d // 2).groupBy("key", "value").agg(F.min("fp").alias("a"))
    return named.join(least, ["key", "value"]).where("a <> fp").select("a", F.col("fp").alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = 4, seed: int = 42, d: int = 4, most: int = MOST) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp long, component_id (smallest doc_id reachable over links of at most d bits),
    root (one fingerprint of the component, the same for all of it) and text_key."""
    rows = cut(fingerprints(docs, shingle, seed))
    held = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(held.select("fp"), d, most))
    named = held.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(named.join(least, "root").select("fp", "component_id", "root"), "fp").select("doc_id", "fp", "component_id", "root", "text_key")


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of ``docs``, all columns, for each component of ``found``: the smallest doc_id; rows without an id stay only where none has one."""
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"))
    kept = first.select(F.col("first.doc_id").alias("__id"), F.col("first.text_key").alias("__key"))
    own = docs.withColumns({"__id_own": F.col("doc_id").cast("long"), "__key_own": text_key()})
    own = own.join(kept, own["__id_own"].eqNullSafe(kept["__id"]) & (own["__key_own"] == kept["__key"]), "left_semi")
    once = F.row_number().over(Window.partitionBy("__id_own", "__key_own").orderBy(F.lit(0)))  # the same row, repeated
    return own.withColumn("__no", once).where("__no = 1").select(*[own[c] for c in docs.columns])


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
