"""Byte-level BPE encoding and decoding with padded numpy matrices.

A text is split by the tokenizer's pattern; each distinct piece of a block is
encoded once.  Pieces of similar length share a padded matrix of token ids; in
each round every row merges its leftmost pair of least rank, so every row loses
one column, and rows without a pair leave the matrix.  Ranks of pairs come from
an open-addressing hash table over (left id, right id).  A piece that is a
token as a whole is that token.  A piece longer than ``LONG`` bytes takes the
same merges through a heap, since a matrix round costs its whole length.

Defined results
* null text counts as empty: no ids, empty bytes;
* one row per row of the input, repeated and null ids included;
* an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmint.llm._util import arrow_schema
from segmint.llm.hashing import HashTable

NONE = np.int32(2**31 - 1)
LONG = 512
#: Cells of a matrix, characters and pieces handled at once, pieces remembered by a worker: all bound memory only.
CELLS, BLOCK_CHARS, BLOCK_PIECES, REMEMBERED = 1 << 20, 1 << 20, 1 << 18, 150_000


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file (a line each: base64 of the bytes, blank, id), by id."""
    with open(path, "rb") as f:
        found = {int(i): base64.b64decode(t) for t, i in map(bytes.split, f)}
    return [found.get(i, b"") for i in range(max(found) + 1)]


class PairTable:
    """(left id, right id) -> rank of the joined token, by open addressing."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        keys = np.array([a << 20 | b for a, b in pairs], dtype=np.int64)
        self.table = HashTable(keys, np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs)))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NONE where there is no such pair, or an id is negative (padding)."""
        found = self.table.get(left.astype(np.int64) << 20 | right, NONE)
        return np.where((left < 0) | (right < 0), NONE, found)


class BytePairEncoder:
    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, regex.compile(pattern)
        self.whole = {t: i for i, t in enumerate(tokens) if t}
        self.bytes = np.array([self.whole[bytes([b])] for b in range(256)], dtype=np.int32)
        self.pairs = {(a, b): i for t, i in self.whole.items() for k in range(1, len(t))
                      if (a := self.whole.get(t[:k])) is not None and (b := self.whole.get(t[k:])) is not None}
        self.table = PairTable(self.pairs)
        self.known: dict[str, bytes] = {}

    def _merge(self, ids: np.ndarray, found: list[bytes], at: np.ndarray) -> None:
        """Encode the rows of ``ids`` (padded by -1) and put row i's packed ids at ``found[at[i]]``."""
        ranks = self.table.ranks(ids[:, :-1], ids[:, 1:])
        while len(ids):
            width, row = ids.shape[1], np.arange(len(ids))
            best = ranks.argmin(axis=1) if width > 1 else np.zeros(len(ids), dtype=np.int64)
            least = ranks[row, best] if width > 1 else np.full(len(ids), NONE)
            over = least == NONE
            if over.any():
                done, there = ids[over], at[over]
                ends = (done >= 0).sum(axis=1).cumsum() * 4
                flat = done[done >= 0].astype("<u4").tobytes()
                for a, b, i in zip([0, *ends[:-1].tolist()], ends.tolist(), there.tolist()):
                    found[i] = flat[a:b]
                go = ~over
                ids, ranks, at, best, least, row = ids[go], ranks[go], at[go], best[go], least[go], row[: go.sum()]
                if not len(ids):
                    return
            ids[row, best] = least
            keep = np.ones(ids.shape, dtype=bool)
            keep[row, best + 1] = False
            ids = ids[keep].reshape(len(ids), width - 1)
            keep = np.ones(ranks.shape, dtype=bool)
            keep[row, best] = False
            ranks = ranks[keep].reshape(len(ids), width - 2)
            if width > 2:
                for where in (best - 1, best):  # the two pairs that the new token stands in
                    ok = np.flatnonzero((where >= 0) & (where < width - 2))
                    ranks[ok, where[ok]] = self.table.ranks(ids[ok, where[ok]], ids[ok, where[ok] + 1])

    def _merge_long(self, piece: bytes) -> bytes:
        """The same merges for one long piece: a heap of (rank, place) over a linked list."""
        ids = self.bytes[np.frombuffer(piece, dtype=np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else len(ids)
            if j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
                if (s := self.pairs.get((r, ids[after[j]]))) is not None:
                    heapq.heappush(heap, (s, i, r, ids[after[j]]))
            if before[i] >= 0 and (s := self.pairs.get((ids[before[i]], r))) is not None:
                heapq.heappush(heap, (s, before[i], ids[before[i]], r))
        return np.array([i for i in ids if i >= 0], dtype="<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids (little-endian, 32 bits) of each piece."""
        found: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.whole.get(p)) is not None:
                found[i] = whole.to_bytes(4, "little")
            elif len(p) > LONG:
                found[i] = self._merge_long(p)
            elif p:
                buckets.setdefault((len(p) + 3) // 4 * 4 if len(p) <= 32 else 1 << (len(p) - 1).bit_length(), []).append(i)
        for width, members in buckets.items():
            step = max(1, CELLS // width)
            for k in range(0, len(members), step):
                at = members[k:k + step]
                raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in at), dtype=np.uint8).reshape(len(at), width)
                lens = np.array([len(pieces[i]) for i in at])
                ids = np.where(np.arange(width) < lens[:, None], self.bytes[raw], np.int32(-1))
                self._merge(ids, found, np.array(at))
        return found

    def _blocks(self, text: str) -> Iterator[list[str]]:
        if len(text) <= BLOCK_CHARS:
            yield self.pattern.findall(text)
            return
        matches = (m.group() for m in self.pattern.finditer(text))
        while block := list(itertools.islice(matches, BLOCK_PIECES)):
            yield block

    def encode_block(self, pieces: list[list[str]]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set().union(*pieces).difference(self.known))
        self.known.update(zip(new, self.encode_pieces([p.encode() for p in new])))
        return [b"".join(map(self.known.__getitem__, p)) for p in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        out, block, size = [], [], 0
        for t in texts:
            if len(t) > BLOCK_CHARS:
                out += self.encode_block(block) if block else []
                block, size = [], 0
                out.append(b"".join(self.encode_block([b])[0] for b in self._blocks(t)))
                continue
            block.append(self.pattern.findall(t))
            size += len(t)
            if size > BLOCK_CHARS:
                out += self.encode_block(block)
                block, size = [], 0
        return out + (self.encode_block(block) if block else [])

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, dtype="<u4")
        return b"".join(b"".join(map(self.tokens.__getitem__, ids[k:k + BLOCK_PIECES].tolist())) for k in range(0, len(ids), BLOCK_PIECES))


_made: dict[str, BytePairEncoder] = {}


def encoder(shared) -> BytePairEncoder:
    """The worker's encoder for a broadcast (digest, tokens, pattern)."""
    digest, tokens, pattern = shared.value
    if digest not in _made:
        _made.clear()
        _made[digest] = BytePairEncoder(tokens, pattern)
    return _made[digest]


def share_vocabulary(docs: DataFrame, vocabulary: str, pattern: str):
    """Broadcast the vocabulary file (its size is fixed) from the driver; executors need no copy of the file."""
    tokens = read_ranks(vocabulary)
    digest = hashlib.sha256(repr((tokens, pattern)).encode()).hexdigest()
    return docs.sparkSession.sparkContext.broadcast((digest, tokens, pattern))


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, decode: bool = False, rows_at_once: int = 256) -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit) and, if asked for, decoded (binary, from the ids)."""
    shared = share_vocabulary(docs, vocabulary, pattern)
    ddl = "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decode
    schema = arrow_schema(docs.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared)
        for whole in batches:
            for k in range(0, whole.num_rows, rows_at_once):
                b = whole.slice(k, rows_at_once)
                ids = enc.encode([t or "" for t in b.column(1).to_pylist()])
                cols = [b.column(0), pa.array([len(p) // 4 for p in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decode:
                    cols.append(pa.array(map(enc.decode, ids), pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ddl)


def decode_documents(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, decoded (binary) from doc_id, ids as ``encode_documents`` gives them; null ids count as none."""
    shared = share_vocabulary(encoded, vocabulary, pattern)
    schema = arrow_schema(encoded.sparkSession, "doc_id long, decoded binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((enc.decode(p or b"") for p in b.column(1).to_pylist()), pa.binary())], schema=schema)

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, decoded binary")
