"""Token counts of a document's sections by offsets.

A whole document is encoded once; the character span of every token is joined
with the sections' spans, both in order, so the join is one search per document.
A token that crosses a boundary is allocated by the rule asked for:

* ``first``: to the section that holds its first character;
* ``last``: to the one that holds its last character;
* ``most``: to the one that holds most of its bytes, the earlier one on a tie;
* ``share``: to each in proportion to its bytes (counts are then fractions).

A character split between tokens belongs to each of them; a token that starts
inside a character starts, for ``first``, in that character's section.

Sections are the lines of the text (a line keeps its line end) or the spans of a
column of ``array<struct<start: int, end: int>>`` in characters.  Counts of a
document's rows add up to its tokens.

Defined results
* null text counts as empty: one empty line, no tokens;
* stated spans are taken in order of their start; where they overlap, a place
  belongs to the one that starts last (then is listed last); ends beyond the text are cut;
* tokens in no section are counted in a row with null section_no, if there are any;
* one set of rows per row of the input, repeated and null ids included;
* an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmint.llm._util import arrow_schema
from segmint.llm.bpe import encoder, share_vocabulary

RULES = ("first", "last", "most", "share")


def lines(data: bytes) -> np.ndarray:
    """Byte spans of the lines, ends included; one for an empty text."""
    ends = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10) + 1
    cuts = np.concatenate([[0], ends, [len(data)] if not len(ends) or ends[-1] < len(data) else []]).astype(np.int64)
    return np.stack([cuts[:-1], cuts[1:]], axis=1) if len(cuts) > 1 else np.zeros((1, 2), dtype=np.int64)


def allocate(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray, rule: str) -> tuple[np.ndarray, float]:
    """Tokens of each span (sorted by start, apart from each other) and of none, by byte offsets."""
    # The gaps between spans become places of their own, so that every byte has one.
    edges = spans.ravel()
    place_of = lambda at: np.searchsorted(edges, at, side="right") - 1  # even: in a span, odd or -1: in a gap
    a, b = place_of(starts), place_of(ends - 1)
    places = np.zeros(len(edges) + 1)  # the last is -1
    if rule == "first" or rule == "last":
        np.add.at(places, a if rule == "first" else b, 1)
    else:
        whole = a == b
        places += np.bincount(a[whole] % len(places), minlength=len(places))
        for s, e, i, j in zip(starts[~whole].tolist(), ends[~whole].tolist(), a[~whole].tolist(), b[~whole].tolist()):
            cuts = [s, *(int(edges[k]) for k in range(i + 1, j + 1)), e]
            sizes = np.diff(cuts)
            if rule == "most":
                places[i + int(sizes.argmax())] += 1
            else:
                places[i:j + 1] += sizes / (e - s) if i >= 0 else 0
                if i < 0:
                    places[-1] += sizes[0] / (e - s)
                    places[:j + 1] += sizes[1:] / (e - s)
    return places[0:len(edges):2], float(places[1:len(edges):2].sum() + places[-1])


def flat(spans: list[tuple[int, int]], size: int) -> tuple[np.ndarray, list[int]]:
    """Spans made apart: pieces (start, end) in order and the number of the span that each belongs to."""
    clean = sorted((max(0, s), min(size, e), k) for k, (s, e) in enumerate(spans) if s is not None and e is not None and max(0, s) < min(size, e))
    out: list[tuple[int, int, int]] = []
    open_: list[tuple[int, int]] = []  # (end, number) of spans that go on below the newest
    at = 0
    for s, e, k in [*clean, (size, size, -1)]:
        while open_ and at < s:
            end, n = open_[-1]
            if end <= at:
                open_.pop()
                continue
            out.append((at, min(end, s), n))
            at = min(end, s)
        at = s
        open_.append((e, k))
    return np.array([(s, e) for s, e, _ in out], dtype=np.int64).reshape(-1, 2), [k for _, _, k in out]


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, rule: str = "first", spans: str | None = None) -> DataFrame:
    """doc_id, section_no (from 0), start, end (characters), n_tokens (long; double for ``share``) for each section of every row of ``docs``."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    shared = share_vocabulary(docs, vocabulary, pattern)
    kind = "double" if rule == "share" else "long"
    ddl = f"doc_id long, section_no int, start long, end long, n_tokens {kind}"
    schema = arrow_schema(docs.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared)
        sizes = np.array(list(map(len, enc.tokens)), dtype=np.int64)
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                texts = [t or "" for t in b.column(1).to_pylist()]
                stated = b.column(2).to_pylist() if spans else [None] * len(texts)
                cols: list[list] = [[], [], [], [], []]
                for i, text, ids, own in zip(b.column(0).to_pylist(), texts, enc.encode(texts), stated):
                    data = text.encode()
                    ends = sizes[np.frombuffer(ids, dtype="<u4")].cumsum()
                    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                    plain = len(data) == len(text)
                    chars = None if plain else np.append(np.flatnonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80), len(data))
                    to_byte = (lambda at: at) if plain else (lambda at: chars[at])
                    to_char = (lambda at: at) if plain else (lambda at: np.searchsorted(chars, at))
                    if spans:
                        listed = [(s["start"], s["end"]) if s else (None, None) for s in own or []]
                        pieces, of = flat(listed, len(text))
                        counts, rest = allocate(starts, ends, to_byte(pieces) if len(pieces) else pieces, rule) if len(pieces) else (np.zeros(0), float(len(ends)))
                        n = np.zeros(len(listed))
                        np.add.at(n, of, counts)
                        bounds = [(s, e) for s, e in listed]
                    else:
                        at = lines(data)
                        n, rest = allocate(starts, ends, at, rule)
                        bounds = to_char(at).tolist()
                    rows = [(i, no, s, e, v) for no, ((s, e), v) in enumerate(zip(bounds, n.tolist()))]
                    if rest > 1e-9:
                        rows.append((i, None, None, None, rest))
                    for c, v in zip(cols, zip(*rows)):
                        c += v
                cols[4] = cols[4] if kind == "double" else [round(v) for v in cols[4]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    columns = [F.col("doc_id").cast("long"), F.col("text").cast("string"), *([F.col(spans)] if spans else [])]
    return docs.select(*columns).mapInArrow(run, ddl)
