"""Approximate nearest neighbours (largest inner product) along shifted Hilbert curves.

Vectors get one more coordinate that makes all lengths equal; a query gets
length one and a zero there, so that the largest inner product is the nearest
point.  Each of ``orderings`` projects them on a few random directions, shifts
them and numbers them along a Hilbert curve; Spark range-partitions an ordering
by that number, queries among the rows.  A query looks at the rows within
``window`` ranks of its place in every ordering, and of its own row's place if
that is another; what the windows find is merged and reranked by the inner product of the original
vectors in double precision.

Rows are indexed in bands of length (a factor of two each); a band is scaled by
its own longest row and searched by every query, so no single row sets the scale
of the others.  Every row is indexed, none is sampled.  The window is a share of
a band's rows (and ``LEAST`` rows at least): vectors without structure, as random ones of 64
dimensions, need a fixed share for a fixed recall, and the work then grows with
queries times rows.  ``window_rows`` sets a fixed number of rows instead, for
vectors that cluster.  Equal vectors are one entry of the index with their
smallest ids, so copies neither fill a window nor a task.

Defined results
* vectors that are null, empty, zero or hold a null or non-finite number take no
  part, neither do rows without an id; vectors of another length are never met;
* repeated ids count once for each different vector; ties go to the smaller id;
* a query without any candidate has no row; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmint.llm._util import arrow_schema, cut

#: An axis has nearly all bits of a double, so that rows in one coarse cell still have an order of their own in every ordering.
AXES, BITS = 8, 48
WORDS = AXES * BITS // 64
SHARE, LEAST = 0.05, 256
#: Rows of an ordering in a block and about the queries of a lot, which one task holds together; parts into which the ids of equal vectors are dealt.
BLOCK, LOT, SALT = 32_768, 16_384, 64


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of points with integer coordinates below 2^bits (n x axes), by the transpose method;
    of more than 64 bits, a row of words of 64 (the last one may have fewer)."""
    x = points.astype(np.uint64).T.copy()
    for b in range(bits - 1, 0, -1):
        q, low = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(len(x)):
            on = (x[i] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], dtype=np.uint64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint64(b)) & np.uint64(1) != 0, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= flip
    words = np.zeros((x.shape[1], -(-bits * len(x) // 64)), dtype=np.uint64)
    for at, (b, row) in enumerate(itertools.product(range(bits - 1, -1, -1), x)):
        words[:, at // 64] = words[:, at // 64] << np.uint64(1) | (row >> np.uint64(b)) & np.uint64(1)
    return words if words.shape[1] > 1 else words[:, 0]


def keys(x: np.ndarray, ordering: int, seed: int) -> np.ndarray:
    """Places (WORDS signed longs each) in one ordering of vectors of length one at most (queries: one)."""
    rng = np.random.default_rng([seed, ordering, x.shape[1]])
    x = np.hstack([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))[:, None]])
    axes = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0][:, :min(AXES, x.shape[1])]
    even = 1 / (1 + np.exp(-1.702 * np.sqrt(x.shape[1]) * (x @ axes)))  # projections, spread about evenly over (0, 1)
    shifted = (even + rng.random(axes.shape[1])) / 2
    place = hilbert((shifted * (1 << BITS)).astype(np.uint64), BITS).reshape(len(x), -1)
    place = np.hstack([place, np.zeros((len(x), WORDS - place.shape[1]), dtype=np.uint64)])  # fewer axes, fewer words
    return (place ^ np.uint64(1 << 63)).view(np.int64)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def _index(vectors: DataFrame, k: int) -> DataFrame:
    """Distinct vectors: rep (their smallest id), dim, band and log (to base 2) of the length, v, ids (the k + 1 smallest)."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    rows = rows.where(F.coalesce(finite, F.lit(False))).where(F.exists("v", lambda x: x != 0)).distinct()
    dealt = rows.withColumn("part", F.pmod("vec_id", F.lit(SALT)))
    first = dealt.withColumn("no", F.row_number().over(Window.partitionBy("v", "part").orderBy("vec_id"))).where(F.col("no") <= k + 1)
    groups = first.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"))  # SALT * (k + 1) ids at most
    # The logarithm of the length, which holds for any finite vector; length 1 is in the middle of a band.
    most = groups.withColumn("most", F.array_max(F.transform("v", F.abs)))
    log = F.log2("most") + F.log2(F.aggregate(F.transform("v", lambda x: x / F.col("most")), F.lit(0.0), lambda a, x: a + x * x)) / 2
    return most.select(F.col("ids")[0].alias("rep"), F.size("v").alias("dim"), F.floor(log + 0.5).cast("int").alias("band"), log.alias("log"), "v", "ids")


def _ranked(index: DataFrame, asked: DataFrame, orderings: int, seed: int) -> DataFrame:
    """dim, band, t, query, rep, rank, n: the place of every vector in every ordering of its band, and how many lie before every query in every band."""
    words = [f"key{i}" for i in range(WORDS)]
    ddl = f"dim int, band int, n long, t int, query boolean, rep long, tie long, {', '.join(f'{w} long' for w in words)}"
    schema = arrow_schema(index.sparkSession, ddl)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reps = b.column(0).to_numpy()
            query, dims, bands, n, scale = (b.column(i).to_numpy(zero_copy_only=False) for i in range(1, 6))
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                x = _matrix(b.column(6).take(pa.array(own)))
                x = x / np.abs(x).max(axis=1)[:, None]
                x = x / np.sqrt((x * x).sum(axis=1))[:, None] * scale[own, None]
                for t in range(orderings):
                    # Equal places: by id, in another order for each ordering.
                    tie = (reps[own].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 * (2 * t + 1) % (1 << 64))).view(np.int64)
                    cols = [dims[own], bands[own], n[own], np.full(len(own), t, dtype=np.int32), query[own], reps[own], tie, *keys(x, t, seed).T]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    sizes = index.groupBy("dim", "band").agg(F.count("*").alias("n"), F.max("log").alias("longest"))  # a row per band
    own = index.join(sizes, ["dim", "band"]).select("rep", F.lit(False).alias("query"), "dim", "band", "n", F.least(F.lit(1.0), F.pow(F.lit(2.0), F.col("log") - F.col("longest"))).alias("scale"), "v")
    queries = index.drop("band").join(asked.select("rep").distinct(), "rep", "left_semi").join(sizes, "dim")
    placed = own.unionByName(queries.select("rep", F.lit(True).alias("query"), "dim", "band", "n", F.lit(1.0).alias("scale"), "v")).mapInArrow(place, ddl)
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["dim", "band", "t", *words, F.desc("query"), "tie"]
    ddl2 = "dim int, band int, n long, t int, query boolean, rep long, part int, no long"
    schema2 = arrow_schema(index.sparkSession, ddl2)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            dims, bands, ts, query = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 4))
            no = np.zeros(b.num_rows, dtype=np.int64)
            for d, band, t in sorted(set(zip(dims.tolist(), bands.tolist(), ts.tolist()))):
                own = np.flatnonzero((dims == d) & (bands == band) & (ts == t))
                rows = (~query[own]).astype(np.int64)
                no[own] = seen.get((d, band, t), 0) + rows.cumsum() - rows
                seen[d, band, t] = seen.get((d, band, t), 0) + int(rows.sum())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(6)), pa.array(np.full(b.num_rows, part, dtype=np.int32)), pa.array(no)], schema=schema2)

    rows = cut(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(number, ddl2))
    counts = rows.groupBy("dim", "band", "t", "part").agg(F.count_if(~F.col("query")).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("dim", "band", "t").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(counts.select("dim", "band", "t", "part", before.alias("before")), ["dim", "band", "t", "part"]).select("dim", "band", "t", "query", "rep", (F.col("before") + F.col("no")).alias("rank"), "n")


def _dealt(rows: DataFrame, queries: DataFrame, lot: int) -> tuple[DataFrame, DataFrame]:
    """Rows and queries of every block with a lot number: queries dealt into lots of about ``lot``, rows in every lot; blocks without queries go."""
    lots = cut(queries.groupBy("d", "of", "o", "b").agg(F.ceil(F.count("*") / lot).cast("int").alias("lots")))  # a row per block
    own = lots.select(F.col("d").alias("dim"), F.col("of").alias("band"), F.col("o").alias("t"), F.col("b").alias("block"), F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"))
    dealt = queries.join(lots, ["d", "of", "o", "b"]).withColumn("l", F.pmod(F.xxhash64("query"), F.col("lots")).cast("int")).drop("lots")
    return rows.join(own, ["dim", "band", "t", "block"]), dealt


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, orderings: int = 16, share: float = SHARE, window_rows: int | None = None, seed: int = 11,
            block: int = BLOCK, lot: int = LOT) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: up to ``k`` rows for each row of ``vectors`` (vec_id, embedding) where ``is_query`` holds."""
    index = cut(_index(vectors, k))
    asked = vectors.where(is_query).select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("v")).where("query_id IS NOT NULL").distinct()
    asked = cut(asked.join(index.select("v", "rep"), "v").select("query_id", "rep"))
    ranked = _ranked(index, asked, orderings, seed).withColumn("w", F.lit(window_rows).cast("long") if window_rows else F.greatest(F.lit(LEAST), F.ceil(F.col("n") * share)).cast("long"))
    placed = cut(ranked)
    rows = placed.where("NOT query").select("dim", "band", "t", F.expr(f"rank div {block}").alias("block"), "rank", "rep").join(index.select("rep", "v"), "rep")
    places = F.sequence(F.expr(f"greatest(start, 0) div {block}"), F.expr(f"least(stop, n - 1) div {block}"))
    # The window of a query's place and, in its own band, the one of its row's place, which is among its near copies; one window where they meet.
    windows = placed.join(asked.select("rep").distinct(), "rep", "left_semi").groupBy("dim", "band", "t", "rep", "n", "w").agg(F.min("rank").alias("low"), F.max("rank").alias("high"))
    windows = windows.selectExpr("dim", "band", "t", "rep", "n", "inline(if(high - low <= 2 * w, array(struct(low - w AS start, high + w AS stop)), array(struct(low - w AS start, low + w AS stop), struct(high - w AS start, high + w AS stop))))")
    queries = windows.join(index.select("rep", "v"), "rep").select(
        F.col("dim").alias("d"), F.col("band").alias("of"), F.col("t").alias("o"), F.explode(places).alias("b"), "start", "stop", F.col("rep").alias("query"), F.col("v").alias("qv"))
    ddl = "q long, c long, score double"
    schema = arrow_schema(vectors.sparkSession, ddl)

    def search(found: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if found.num_rows and asked.num_rows:
            order = np.argsort(found.column("rank").to_numpy())
            ranks, reps, x = found.column("rank").to_numpy()[order], found.column("rep").to_numpy()[order], _matrix(found.column("v"))[order]
            q_order = np.argsort(asked.column("start").to_numpy())
            start, stop, q_rep = (asked.column(c).to_numpy()[q_order] for c in ("start", "stop", "query"))
            q = _matrix(asked.column("qv"))[q_order]
            lo, hi = np.searchsorted(ranks, start), np.searchsorted(ranks, stop, side="right")
            for s in range(0, len(q), 64):
                scores = q[s:s + 64] @ x[lo[s]:hi[s:s + 64].max()].T
                for i in range(s, min(s + 64, len(q))):
                    own = scores[i - s, lo[i] - lo[s]:hi[i] - lo[s]]
                    if not len(own):
                        continue
                    least = np.partition(own, -(k + 1))[-(k + 1)] if len(own) > k + 1 else -np.inf
                    near = np.flatnonzero(own >= least - 1e-9 * max(1.0, abs(least))) if np.isfinite(least) else np.arange(len(own))
                    near = near + lo[i]
                    exact = (x[near] * q[i]).sum(axis=1)
                    best = np.lexsort((reps[near], -exact))[:k + 1]
                    for c, v in zip(out, (np.full(len(best), q_rep[i]), reps[near][best], exact[best])):
                        c.append(v)
        return pa.Table.from_arrays([pa.array(np.concatenate(c) if c else [], f.type) for c, f in zip(out, schema)], schema=schema)

    rows, queries = _dealt(rows, queries, lot)
    pairs = rows.groupBy("dim", "band", "t", "block", "lot").cogroup(queries.groupBy("d", "of", "o", "b", "l")).applyInArrow(search, ddl)
    pairs = pairs.groupBy("q", "c").agg(F.max("score").alias("score"))
    best = pairs.withColumn("no", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))).where(F.col("no") <= k + 1)
    # The smallest ids of equal vectors, then k + 1 of all: a list for each query vector, without the query's own id.
    named = best.join(index.select(F.col("rep").alias("c"), "ids"), "c").select("q", "score", F.explode("ids").alias("vec_id"))
    one = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    named = named.withColumn("no", one).where(F.col("no") <= k + 1)
    lists = named.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("no", "vec_id", "score"))).alias("found"))  # k + 1 at most
    got = asked.join(lists, asked["rep"] == lists["q"]).select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return got.select("query_id", F.posexplode("found").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
