"""Exact dedup by composable polynomial fingerprints.

A text is normalised by deleting every blank of ``[\\x20\\x09-\\x0D]``.  The
fingerprint of a byte string b_1..b_n is ``sum b_i * B^(n-i)`` modulo two
primes, next to its length.  Two strings' fingerprints combine without their
bytes: ``H(xy) = H(x) * B^len(y) + H(y)``, so a huge text is hashed in chunks,
all at once, and folded.  Texts that share fingerprint and length are then
compared chunk by chunk; a fingerprint shared by different texts is split.

Defined results
* null text counts as empty; empty texts equal each other;
* of equal texts the row with most code points in the original text stays,
  then the smallest doc_id; a null doc_id is larger than any other;
* of rows with the same doc_id and equal texts one stays;
* an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segmint.llm._util import BLANK_BYTES, BLANKS, cut, map_arrow, text_bytes

#: Two primes below 2^31 and a base for each: a chunk's sum of 2^16 products stays below 2^63.
PRIMES = ((2147483647, 1099087573), (2147483629, 754974721))
CHUNK = 1 << 16
#: Bytes compared at once when equal fingerprints are checked.
COMPARE = 1 << 18


class Fingerprint:
    """Fingerprint of a byte string; ``+`` joins those of neighbouring parts."""

    __slots__ = ("hashes", "length", "primes")

    def __init__(self, hashes: tuple[int, ...], length: int, primes=PRIMES):
        self.hashes, self.length, self.primes = hashes, length, primes

    def __add__(self, other: "Fingerprint") -> "Fingerprint":
        return Fingerprint(tuple((h * pow(b, other.length, p) + g) % p for (p, b), h, g in zip(self.primes, self.hashes, other.hashes)),
                           self.length + other.length, self.primes)

    def key(self) -> int:
        k = 0
        for (p, _), h in zip(self.primes, self.hashes):
            k = (k << p.bit_length()) | h
        return k


class Hasher:
    """Hashes chunks with tables of powers; one for each task."""

    def __init__(self, primes=PRIMES, chunk: int = CHUNK):
        self.primes, self.chunk, self.powers = primes, chunk, []
        for p, b in primes:
            pw = np.ones(1, dtype=np.uint64)
            while len(pw) < chunk:  # doubling: b^0..b^(2n-1) from b^0..b^(n-1)
                pw = np.concatenate([pw, pw * np.uint64(pow(b, len(pw), p)) % np.uint64(p)])
            self.powers.append(pw[:chunk][::-1].copy())

    def of(self, data: bytes) -> Fingerprint:
        a = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
        whole = len(a) // self.chunk * self.chunk
        found = Fingerprint((0,) * len(self.primes), 0, self.primes)
        if whole:
            parts = [a[:whole].reshape(-1, self.chunk) @ pw % np.uint64(p) for (p, _), pw in zip(self.primes, self.powers)]
            for hs in zip(*parts):
                found = found + Fingerprint(tuple(map(int, hs)), self.chunk, self.primes)
        rest = a[whole:]
        if len(rest) or not whole:
            hs = tuple(int((rest @ pw[self.chunk - len(rest):]) % np.uint64(p)) for (p, _), pw in zip(self.primes, self.powers))
            found = found + Fingerprint(hs, len(rest), self.primes)
        return found


def normalised(data: bytes) -> bytes:
    return data.translate(None, BLANK_BYTES)


def fingerprints(docs: DataFrame, primes=PRIMES) -> DataFrame:
    """doc_id, n_chars (code points of the original), fp, n_bytes, text_sha256 (of the normalised text), a row each."""
    made: dict = {}

    def rows(b: dict[str, list]) -> dict[str, list]:
        hasher = made.get("hasher") or made.setdefault("hasher", Hasher(primes))
        out = {"doc_id": b["doc_id"], "n_chars": b["n_chars"], "fp": [], "n_bytes": [], "text_sha256": []}
        for t in b["text"]:
            t = normalised(t)
            f = hasher.of(t)
            out["fp"].append(f.key())
            out["n_bytes"].append(f.length)
            out["text_sha256"].append(hashlib.sha256(t).hexdigest())
        return out

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), text_bytes()), rows,
                     "doc_id long, n_chars long, fp long, n_bytes long, text_sha256 string")


def _chunks(docs: DataFrame, primes) -> DataFrame:
    made: dict = {}

    def rows(b: dict[str, list]) -> dict[str, list]:
        hasher = made.get("hasher") or made.setdefault("hasher", Hasher(primes))
        out = {"text_sha256": [], "fp": [], "n_bytes": [], "chunk_no": [], "chunk": []}
        for t in b["text"]:
            t = normalised(t)
            k, sha = hasher.of(t).key(), hashlib.sha256(t).hexdigest()
            for no, at in enumerate(range(0, max(1, len(t)), COMPARE)):
                for c, v in zip(out.values(), (sha, k, len(t), no, t[at:at + COMPARE])):
                    c.append(v)
        return out

    return map_arrow(docs.select(text_bytes()), rows, "text_sha256 string, fp long, n_bytes long, chunk_no int, chunk binary")


def exact_dedup(docs: DataFrame, primes=PRIMES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (see the module for the rules)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cut(fingerprints(docs, primes))
    key = ["fp", "n_bytes"]
    shared = rows.groupBy(*key).count().where("count > 1").select(*key)
    ids = rows.join(shared, key, "left_semi").select(F.col("doc_id").alias("cand")).distinct()
    chunks = _chunks(docs.join(ids, docs["doc_id"].eqNullSafe(ids["cand"]), "left_semi"), primes)
    # Equal chunks of a group collapse before the shuffle; two contents at one place show a collision.
    contents = chunks.select(*key, "chunk_no", "chunk").distinct()
    clashes = cut(contents.groupBy(*key, "chunk_no").count().where("count > 1").select(*key).distinct())
    rows = rows.withColumn("part", F.lit(""))
    if not clashes.isEmpty():
        # A text has one content at each place, so the least digest of its texts names a content; ids name neither.
        of = chunks.join(clashes, key, "left_semi").distinct()
        named = of.groupBy(*key, "chunk_no", "chunk").agg(F.min("text_sha256").alias("name"))
        parts = (of.join(named, [*key, "chunk_no", "chunk"]).groupBy("text_sha256", *key)
                 .agg(F.to_json(F.array_sort(F.collect_list(F.struct("chunk_no", "name")))).alias("found")))
        rows = rows.drop("part").join(parts, ["text_sha256", *key], "left").withColumn("part", F.coalesce("found", F.lit(""))).drop("found")
    key = [*key, "part"]
    last = F.lit((1 << 63) - 1)
    best = (rows.groupBy(*key).agg(F.max(F.struct("n_chars", (-F.coalesce("doc_id", last)).alias("rank"))).alias("best"), F.count("*").alias("group_size"))
            .select(*key, "group_size", F.col("best.n_chars").alias("most"), F.nullif(-F.col("best.rank"), last).alias("keep_id")))
    again = F.row_number().over(Window.partitionBy("doc_id", *key).orderBy(F.desc("n_chars"), "text_sha256"))
    return (rows.withColumn("again", again).join(best, key)
            .select("doc_id", "keep_id", "group_size",
                    (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("most")) & (F.col("again") == 1)).alias("kept"), "text_sha256"))


def keep_one(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decisions`` (of ``exact_dedup``) keeps, all columns, each once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = decisions.where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    marked = docs.withColumn("__sha_own", F.sha2(F.translate(text, BLANKS, "").cast("binary"), 256))
    marked = marked.join(kept, marked["doc_id"].cast("long").eqNullSafe(kept["__id"]) & (marked["__sha_own"] == kept["__sha"]), "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id", "__sha_own").orderBy(F.desc(F.length(text)), text))
    return marked.withColumn("__no", first).where("__no = 1").select(*[marked[c] for c in docs.columns])
