"""Standardisation and k-means.

Design notes
------------
* Standardising needs one aggregate (mean and population std per column);
  the 2*v numbers come to the driver and re-enter the plan as literals, so
  the scaled columns are plain codegen'd arithmetic.
* K-means does not depend on cores, partitions or row order.  Points are
  standardised values in whole units of ``UNIT``; sums over rows are sums of
  whole numbers and so exact in any order, and distances are computed row by
  row in one order of the columns.  Starting centres follow from the rows
  alone: step by step the row with the largest ``d^2 / -ln(u)``, where u comes
  from an md5 of (seed, start, step, key) - the usual draw in proportion to the
  squared distance, without a random generator that a partition would own.
* Every pass works on all fits at once: all starts, and for the elbow all k.
  A pass is one job: nearest centre of each fit, then sums by (fit, label).
* Once the centres move little, the rows are written with their label and the
  slack of it: how much nearer its centre is than the second nearest.  A label holds
  while the moves of the centres since then add up to less, so later passes
  compute distances only for rows whose slack is used up (the file is sorted by
  slack, so most of it is skipped), and correct the sums by the rows that changed.
  Sums are whole numbers, so the centres are the same as without this.
* Distances are taken in the tasks, a batch of rows (Arrow) against all centres
  of a fit at a time (NumPy), whatever k is; each is the sum of the same products
  in the same order as row by row.  A task gives one partial sum per batch, fit
  and label, which Spark adds up, so a pass expands no row.
* Clusters are numbered canonically (centres in ascending lexicographic
  order), so the numbering does not depend on the starts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmint.session import cut_lineage, release

# One unit of a coordinate; how many starts every seed gives, and from how many passes over the rows.
UNIT = 1e-6
STARTS = 2
ROUNDS = 3
# Rows are written with their slack once no centre moves more than this share of the mean distance between neighbouring
# centres, and again once more than this share of them has to be compared.  Both change the work only, never a result.
SETTLED = 0.02
WORN = 0.5
# Distances that a task holds at once, and the size below which sums of whole numbers are exact as doubles.
HELD = 1 << 15
EXACT = float(1 << 53)


def standard_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    """Mean and population std of every column (one aggregate, 2*v numbers)."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}__m"), F.stddev_pop(x).alias(f"{c}__s")]
    row = df.agg(*aggs).first()
    return {c: (row[f"{c}__m"], row[f"{c}__s"]) for c in columns}


def steady(stats: dict[str, tuple[float | None, float | None]]) -> dict[str, tuple[float | None, float | None]]:
    """The stats at 12 significant digits: what differs with the order of a sum is beyond them."""
    return {c: tuple(None if x is None else float(f"{x:.12g}") for x in ms) for c, ms in stats.items()}


def _scaled(column: str, stats: tuple[float | None, float | None]) -> Column:
    m, s = stats
    x = F.col(column).cast("double")
    if m is None:
        return x
    return (x - F.lit(m)) / F.lit(s) if s else x - F.lit(m)


def standardize(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (),
                stats: dict | None = None) -> DataFrame:
    """``(x - mean) / std`` with the population std (M1; StandardScaler semantics).

    A constant column (std 0) scales to 0; null stays null.  ``keep`` lists
    columns carried through unchanged (ids, reporting columns).  Without
    ``stats`` the columns are written once (checkpoint folder), so a costly
    ``df`` is not evaluated twice.
    """
    if stats is None:
        df = cut_lineage(df.select(*keep, *[c for c in columns if c not in keep]))
        stats = standard_stats(df, columns)
    return df.select(*[F.col(c) for c in keep], *[_scaled(c, stats[c]).alias(c) for c in columns])


def prepare_features(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Preparation before k-means (M2): select, fill nulls with 0, standardise."""
    from segmint.functions.prep import fill_selected

    chosen = cut_lineage(fill_selected(df.select(*keep, *columns), columns, 0, None))
    return _from_files(standardize(chosen, columns, keep=keep, stats=steady(standard_stats(chosen, columns))))


def _from_files(df: DataFrame) -> DataFrame:
    """Mark a frame that only reads and projects a written table: the fits then need not write it again."""
    df._segmint_from_files = True
    return df


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """Model columns as one vector column (P7).  Inputs must be non-null."""
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="error").transform(df)


# ---------------------------------------------------------------------------
# Given centres (M4, M5, M9)
# ---------------------------------------------------------------------------

def nearest(columns: Sequence[str], centres: Sequence[Sequence[float]]) -> Column:
    """``struct(d, c)`` of the nearest centre: squared distance and index (M4).

    Ties go to the lower index (``argmin``); a row with a null coordinate has
    no nearest centre: the struct is null.
    """
    compare = _comparer([centres])

    @F.arrow_udf("struct<d: double, c: int>")
    def near(*xs: pa.Array) -> pa.Array:
        d, c, _ = compare(0, [x.to_numpy(zero_copy_only=False) for x in xs])
        return pa.StructArray.from_arrays([pa.array(d), pa.array(c)], names=["d", "c"])

    xs = [F.col("`" + c.replace("`", "``") + "`").cast("double") for c in columns]
    here = xs[0].isNotNull()
    for x in xs[1:]:
        here = here & x.isNotNull()
    return F.when(here, near(*xs))


def _comparer(fits: Sequence[Sequence[Sequence[float]]]) -> Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """``compare(fit, xs)`` for the tasks: squared distance and index of the nearest centre of points given as one array
    per coordinate, and with ``second`` the squared distance of the next one (infinite where there is none).

    The squares are added in the order of the coordinates; ties go to the lower index, and NaN is farther than any number.
    """
    tables = [np.array(centres, dtype=np.float64) for centres in fits]
    held = HELD

    def compare(fit: int, xs: Sequence[np.ndarray], second: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        centres, rows = tables[fit], len(xs[0])
        d, c = np.empty(rows), np.empty(rows, dtype=np.int32)
        after = np.empty(rows) if second else None
        size = max(64, held // len(centres))
        with np.errstate(all="ignore"):
            for at in range(0, rows, size):
                here, far = slice(at, at + size), None
                for x, v in zip(xs, centres.T):
                    step = x[here] - v[:, None]
                    step *= step
                    far = step if far is None else np.add(far, step, out=far)
                d[here] = least = np.fmin.reduce(far, axis=0)
                c[here] = own = (far == least).argmax(axis=0)
                if second:
                    far[own, np.arange(far.shape[1])] = np.inf
                    after[here] = far.min(axis=0)
        return d, c, after

    return compare


def assign_nearest(df: DataFrame, columns: Sequence[str], centres: Sequence[Sequence[float]],
                   label: str = "Cluster", distance: str | None = None) -> DataFrame:
    """Label every row with its nearest centre (M4); optionally keep the distance.

    A row with a null coordinate gets a null label and a null distance.
    """
    compare, types = _comparer([centres]), dict(df.dtypes)
    others = [c for c in dict.fromkeys(columns) if types.get(c) != "double"]
    xs = [f"__x{others.index(c)}" if c in others else c for c in columns]
    rows = df.select("*", *[F.col("`" + c.replace("`", "``") + "`").cast("double").alias(f"__x{i}") for i, c in enumerate(others)])
    at, names = [rows.columns.index(x) for x in xs], [*df.columns, "__c", "__d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = [b.column(i) for i in at]
            d, c, _ = compare(0, [x.to_numpy(zero_copy_only=False) for x in points])
            null = np.any([x.is_null().to_numpy(zero_copy_only=False) for x in points], axis=0)
            yield pa.RecordBatch.from_arrays([*b.columns[:len(names) - 2], pa.array(c, mask=null), pa.array(d, mask=null)], names=names)

    schema = T.StructType([*df.schema.fields, T.StructField("__c", T.IntegerType()), T.StructField("__d", T.DoubleType())])
    plain = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])  # mapInArrow looks its columns up by name
    out = plain.mapInArrow(run, schema).withColumn(label, F.col("__c"))
    if distance:
        out = out.withColumn(distance, F.col("__d"))
    return out.drop("__c", "__d")


def collect_centres(centres_df: DataFrame, columns: Sequence[str], label: str, k: int) -> tuple[list, list[list[float]]]:
    """Bring a centre table of ``k`` rows at most (one per label) to the driver."""
    rows = centres_df.select(label, *columns).limit(k + 1).collect()
    if len(rows) > k:
        raise ValueError(f"more than {k} centres")
    rows.sort(key=lambda r: r[label])
    return [r[label] for r in rows], [[float(r[c]) for c in columns] for r in rows]


def inertia(df: DataFrame, columns: Sequence[str], label: str,
            centres_df: DataFrame) -> DataFrame:
    """Total squared distance of every row to the centre of its label (M5).

    ``centres_df`` holds one row per label with the centre coordinates in the
    same column names; it is an ordinary join side (broadcast where the planner
    finds it small).
    """
    c = centres_df.select(F.col(label), *[F.col(x).alias(f"__c_{x}") for x in columns])
    joined = df.select(label, *columns).join(c, label)
    d = None
    for x in columns:
        t = (F.col(x) - F.col(f"__c_{x}")) * (F.col(x) - F.col(f"__c_{x}"))
        d = t if d is None else d + t
    return joined.agg(F.sum(d).alias("inertia"))


def centroid_update(df: DataFrame, columns: Sequence[str], label: str = "Cluster") -> DataFrame:
    """One Lloyd step's centre update: the mean of each label's rows (M9)."""
    return df.groupBy(label).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns],
                                 F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------
# K-means (M3, M6, M7)
# ---------------------------------------------------------------------------

@dataclass
class KMeansFit:
    k: int
    centres: list[list[float]]          # canonical order, in the units of the fitted columns
    inertia: float
    seed: int
    compared: tuple[int, ...] = ()      # per pass: rows times fits whose distances were computed


def in_units(column: Column) -> Column:
    """A coordinate as a whole number of units (held as a double); null is an error."""
    whole = F.floor(column.cast("double") / F.lit(UNIT) + F.lit(0.5)).cast("double")
    return F.when(column.isNull(), F.raise_error(F.lit("k-means needs non-null coordinates")).cast("double")).otherwise(whole)


def _points(df: DataFrame, columns: Sequence[str], key: str | None) -> tuple[DataFrame, list[str]]:
    """The coordinates in units and the key as text, for the passes."""
    qs = [f"__q{i}" for i in range(len(columns))]
    coords = [in_units(F.col(c)).alias(q) for c, q in zip(columns, qs)]
    out = df.select(*coords, *([F.col(key).cast("string").alias("__key")] if key else []))
    if not key:  # equal points then draw the same number
        out = out.withColumn("__key", F.concat_ws(",", *[F.col(q).cast("decimal(38,0)").cast("string") for q in qs]))
    return out, qs


def _draw(seed: int, part: str) -> Column:
    """A number in (0, 1) from the key: 52 bits of an md5."""
    text = F.concat(F.lit(f"{seed}|{part}|"), F.coalesce("__key", F.lit("")))
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def _draw_here(seed: int, part: str, key: str) -> float:
    """The same number for one key."""
    bits = int(hashlib.md5(f"{seed}|{part}|{key}".encode()).hexdigest()[:13], 16)
    return (float(bits) + 0.5) / float(1 << 52)


def _candidates(points: DataFrame, qs: list[str], many: int, seed: int) -> list[tuple[str, list[float], float]]:
    """(key, coordinates, weight) of points that the starts choose from: ``ROUNDS`` passes take the ``many`` points
    that come first in a draw in proportion to the squared distance from those taken before; the weight is the
    number of points nearest to it."""
    taken: list = []
    for r in range(ROUNDS):
        weight = nearest(qs, [[row[q] for q in qs] for row in taken])["d"] if taken else F.lit(1.0)
        score = (weight / -F.log(_draw(seed, f"r{r}"))).alias("score")
        key = F.coalesce("__key", F.lit("")).alias("key")
        first = points.select(score, key, *qs).orderBy(F.desc("score"), "key", *qs).limit(many).collect()
        taken += [row for row in first if row["score"] is not None and not row["score"] <= 0]  # here, so that no plan takes the distances twice
    coords = [[row[q] for q in qs] for row in taken]
    if not coords:
        return []
    counts = {r["c"]: r["n"] for r in points.select(nearest(qs, coords)["c"].alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [(row["key"], c, float(counts.get(i, 0))) for i, (row, c) in enumerate(zip(taken, coords))]


def _starting_centres(candidates: list[tuple[str, list[float], float]], k: int, seed: int, start: int) -> list[list[float]]:
    """Up to k of the candidates, one after the other in proportion to weight times squared distance; the first of
    them do not depend on k."""
    found: list[list[float]] = []
    near = [1.0] * len(candidates)
    for step in range(k):
        scores = [w * d / -math.log(_draw_here(seed, f"s{start}.{step}", key)) for (key, _, w), d in zip(candidates, near)]
        best = max(range(len(scores)), key=lambda i: (scores[i], -i), default=None)
        if best is None or scores[best] <= 0:
            break
        centre = candidates[best][1]
        found.append(centre)
        for i, (_, x, _) in enumerate(candidates):
            d = 0.0
            for u, v in zip(x, centre):
                d = d + (u - v) * (u - v)
            near[i] = min(near[i], d) if step else d
    return found


def _adder(names: Sequence[str], qs: Sequence[str]) -> Callable[..., pa.RecordBatch]:
    """``add(groups, at, xs)`` for the tasks: a batch of sums (whole numbers) and row counts; row i of the points belongs to
    the group ``groups[at[i]]``, a value for each of ``names``."""
    names, exact = [*names, *qs, "n"], EXACT

    def total(x: np.ndarray, at: np.ndarray, groups: int) -> pa.Array:
        if len(x) * np.abs(x).max(initial=0.0) < exact:
            return pa.array(np.bincount(at, weights=x, minlength=groups).astype(np.int64))
        sums = [0] * groups
        for i, v in zip(at.tolist(), x.tolist()):
            sums[i] += min(int(v), (1 << 63) - 1)
        return pa.array(sums, pa.int64())  # an error where a sum is beyond a long, as in Spark

    def add(groups: Sequence[tuple[int, ...]], at: np.ndarray, xs: Sequence[np.ndarray]) -> pa.RecordBatch:
        n = np.bincount(at, minlength=len(groups))
        keys = [pa.array(list(k), pa.int32()) for k in zip(*groups)]
        columns = [*keys, *[total(x, at, len(groups)) for x in xs], pa.array(n)]
        return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(n > 0))

    return add


def _added(partial: DataFrame, names: Sequence[str], qs: Sequence[str]) -> list:
    return partial.groupBy(*names).agg(*[F.sum(x).alias(x) for x in (*qs, "n")]).collect()


def _sums_ddl(names: Sequence[str], qs: Sequence[str]) -> str:
    return ", ".join([f"{n} int" for n in names] + [f"`{q}` long" for q in (*qs, "n")])


def _label_sums(points: DataFrame, qs: list[str], fits: Sequence[Sequence[Sequence[float]]]) -> list:
    """Rows ``(fit, c, sums, n)``: the points nearest to each centre, by fit."""
    names = ["fit", "c"]
    compare, add = _comparer(fits), _adder(names, qs)
    groups = [[(f, i) for i in range(len(centres))] for f, centres in enumerate(fits)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = [x.to_numpy(zero_copy_only=False) for x in b.columns]
            parts = [add(own, compare(f, xs)[1], xs) for f, own in enumerate(groups)]
            yield from pa.Table.from_batches(parts).combine_chunks().to_batches()

    return _added(points.select(*qs).mapInArrow(run, _sums_ddl(names, qs)), names, qs)


def _centres_moved(old: list[list[float]], now: list[list[float]]) -> list[float]:
    return [math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y))) for x, y in zip(old, now)]


def _spacing(centres: list[list[float]]) -> float:
    """Mean distance of a centre to the nearest other one."""
    near = [min((math.dist(c, o) for j, o in enumerate(centres) if j != i), default=math.inf) for i, c in enumerate(centres)]
    return sum(near) / len(near)


class _Slack:
    """The rows with label and slack in every going fit, as written at ``centres``, and the labels' sums then."""

    def __init__(self, points: DataFrame, qs: list[str], fits: dict[int, list[list[float]]]):
        self.qs, self.order = qs, sorted(fits)
        self.centres = {f: [list(c) for c in fits[f]] for f in self.order}
        compare, slots = _comparer([fits[f] for f in self.order]), range(len(self.order))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                xs = [x.to_numpy(zero_copy_only=False) for x in b.columns]
                for slot in slots:
                    d, label, second = compare(slot, xs, second=True)
                    one, two = np.sqrt(d), np.sqrt(second)
                    with np.errstate(invalid="ignore"):
                        slack = two - one - (two + one) * 1e-9 - 1e-3  # less what rounding could add to a distance
                    columns = [pa.array(np.full(len(d), slot, dtype=np.int32)), pa.array(label), pa.array(slack), *b.columns]
                    yield pa.RecordBatch.from_arrays(columns, names=["slot", "label", "slack", *qs])

        rows = points.select(*qs).mapInArrow(run, "slot int, label int, slack double, " + ", ".join(f"`{q}` double" for q in qs))
        self.rows = cut_lineage(rows.sortWithinPartitions("slot", "slack"))
        found = self.rows.groupBy("slot", "label").agg(*[F.sum(F.col(q).cast("long")).alias(q) for q in qs], F.count(F.lit(1)).alias("n")).collect()
        self.sums = {(self.order[r["slot"]], r["label"]): ([r[q] for q in qs], r["n"]) for r in found}
        self.size = sum(r["n"] for r in found)

    def step(self, fits: dict[int, list[list[float]]]) -> tuple[dict[tuple[int, int], tuple[list[int], int]], int]:
        """Sums by (fit, label) at the centres of ``fits`` and the number of rows compared."""
        allowed = []
        for f in self.order:
            moved = [0.0] * len(self.centres[f]) if f not in fits else _centres_moved(self.centres[f], fits[f])
            most = sorted(moved)[-2:]
            allowed.append([(m + (most[0] if m == most[-1] else most[-1]) if len(moved) > 1 else 0.0) * (1 + 1e-9) if f in fits else -math.inf for m in moved])
        limit = max(x for own in allowed for x in own)
        table = "array(" + ", ".join("array(" + ", ".join("-1e300D" if x == -math.inf else f"{x!r}D" for x in own) + ")" for own in allowed) + ")"
        limit = f"slack <= {limit!r}D AND " if math.isfinite(limit) else ""
        worn = self.rows.where(f"{limit}slack <= {table}[slot][label]").select("slot", "label", *self.qs)
        names, centres = ["slot", "label", "c"], [fits.get(f, [[0.0] * len(self.qs)]) for f in self.order]
        compare, add = _comparer(centres), _adder(names, self.qs)
        sizes = [len(own) for own in centres]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                slots, labels, *xs = [x.to_numpy(zero_copy_only=False) for x in b.columns]
                for slot in np.unique(slots).tolist():
                    here, k = slots == slot, sizes[slot]
                    own = [x[here] for x in xs]
                    groups = [(slot, old, c) for old in range(k) for c in range(k)]
                    yield add(groups, labels[here] * k + compare(slot, own)[1], own)

        found = _added(worn.mapInArrow(run, _sums_ddl(names, self.qs)), names, self.qs)
        sums = {own: (list(total), n) for own, (total, n) in self.sums.items() if own[0] in fits}
        for r in found:
            if r["c"] != r["label"]:
                f = self.order[r["slot"]]
                for at, sign in (((f, r["label"]), -1), ((f, r["c"]), 1)):
                    total, n = sums.get(at, ([0] * len(self.qs), 0))
                    sums[at] = ([t + sign * r[q] for t, q in zip(total, self.qs)], n + sign * r["n"])
        return sums, sum(r["n"] for r in found)


def _lloyd(points: DataFrame, qs: list[str], fits: list[list[list[float]]], max_iter: int, stop: float,
           settled: float = SETTLED) -> tuple[list[list[list[float]]], list[int]]:
    """Lloyd steps of all fits at once until each moved by ``stop`` (sum of squares, units) or less; also the rows compared in every pass."""
    going = set(range(len(fits)))
    kept: _Slack | None = None
    settle, compared, n = False, [], 0
    for _ in range(max_iter):
        order = sorted(going)
        now = {f: fits[f] for f in order}
        if kept is None and settle:
            kept = _Slack(points, qs, now)
            sums, touched = kept.sums, kept.size
        elif kept is not None:
            sums, touched = kept.step(now)
            if touched > WORN * n * len(order):
                release(kept.rows)
                kept = None
        else:
            rows = _label_sums(points, qs, [fits[f] for f in order])
            sums = {(order[r["fit"]], r["c"]): ([r[q] for q in qs], r["n"]) for r in rows}
            touched = sum(r["n"] for r in rows)
            n = touched // len(order)
        compared.append(touched)
        settle = True
        for f in order:
            new = [[float(t) / float(m) for t in total] if m else list(old)     # a centre without rows stays
                   for old, (total, m) in ((c, sums.get((f, i), ([], 0))) for i, c in enumerate(fits[f]))]
            settle = settle and max(_centres_moved(fits[f], new)) <= settled * _spacing(new)
            moved = sum((a - b) ** 2 for old, at in zip(fits[f], new) for a, b in zip(old, at))
            fits[f] = new
            if moved <= stop:
                going.discard(f)
        if not going:
            break
    if kept is not None:
        release(kept.rows)
    return fits, compared


def _inertias(points: DataFrame, qs: list[str], fits: Sequence[Sequence[Sequence[float]]]) -> dict[int, float]:
    """Inertia of every fit, summed exactly, in the units of the fitted columns."""
    compare, order = _comparer(fits), range(len(fits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = [x.to_numpy(zero_copy_only=False) for x in b.columns]
            for f in order:
                d = compare(f, xs)[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), f, dtype=np.int32)), pa.array(d)], names=["fit", "d"])

    near = points.select(*qs).mapInArrow(run, "fit int, d double")
    total = F.sum(F.col("d").cast("decimal(38,3)")).cast("double") * F.lit(UNIT) * F.lit(UNIT)
    return {r["fit"]: r["inertia"] for r in near.groupBy("fit").agg(total.alias("inertia")).collect()}


def _spread(points: DataFrame, qs: list[str]) -> float:
    """Mean of the columns' population variances, in units."""
    row = points.agg(*[F.var_pop(q).alias(q) for q in qs]).first()
    return sum(row[q] or 0.0 for q in qs) / max(1, len(qs))


def fit_kmeans(df: DataFrame, columns: Sequence[str], k: int, seeds: Sequence[int] = (42,),
               max_iter: int = 300, tol: float = 1e-4, starts: int = STARTS, key: str | None = None) -> KMeansFit:
    """Fit k-means from ``starts`` starts of every seed and keep the lowest inertia.

    ``columns`` are standardised (or on a like scale); ``key`` names a column
    that tells rows apart in the draws.  ``tol`` is relative, as in the
    reference's solver: steps stop when the centres' squared moves add up to
    ``tol`` times the mean variance.  Inertia is that of the final labels (T2).
    With fewer distinct points than k there are fewer clusters (T9).
    """
    fits, costs, compared = _fit_all(df, columns, [k], seeds, max_iter, tol, starts, key)
    i = min(costs, key=lambda f: (costs[f], f))
    centres = sorted([v * UNIT for v in c] for c in fits[i])
    return KMeansFit(k=len(centres), centres=centres, inertia=costs[i], seed=seeds[i // starts], compared=tuple(compared))


def _fit_all(df: DataFrame, columns: Sequence[str], ks: Sequence[int], seeds: Sequence[int], max_iter: int, tol: float,
             starts: int, key: str | None) -> tuple[list[list[list[float]]], dict[int, float], list[int]]:
    """Centres (in units) of every fit - all starts of the first k, then of the next -, their inertias, and the rows compared in every pass."""
    points, qs = _points(df, columns, key)
    own = not getattr(df, "_segmint_from_files", False)
    written = cut_lineage(points) if own else points
    cores = df.sparkSession.sparkContext.defaultParallelism
    spread = written if written.rdd.getNumPartitions() >= cores else written.repartition(cores)  # speed only: any layout gives the same fit
    points = spread.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        first = []
        for s in seeds:
            candidates = _candidates(points, qs, 2 * max(ks), s)
            if not candidates:
                raise ValueError("k-means needs at least one row")
            first += [_starting_centres(candidates, max(ks), s, n) for n in range(starts)]
        fits = [own[:k] for k in ks for own in first]
        stop = tol * _spread(points, qs) if tol else 0.0
        fits, compared = _lloyd(points, qs, fits, max_iter, stop)
        return fits, _inertias(points, qs, fits), compared
    finally:
        points.unpersist()
        if own:
            release(written)


def label(fit: KMeansFit, df: DataFrame, columns: Sequence[str], label_col: str = "Cluster") -> DataFrame:
    """Cluster of every row by the fitted (standardised) columns, canonical numbering."""
    qs = [f"__q{i}" for i in range(len(columns))]
    out = df.withColumns({q: in_units(F.col(c)) for q, c in zip(qs, columns)})
    return assign_nearest(out, qs, [[v / UNIT for v in c] for c in fit.centres], label_col).drop(*qs)


def elbow_curve(df: DataFrame, columns: Sequence[str], k_max: int, k_min: int = 3,
                seed: int = 42, max_iter: int = 300, tol: float = 1e-4,
                starts: int = STARTS, key: str | None = None) -> DataFrame:
    """Inertia for every k in ``k_min..k_max`` (M6) as a DataFrame ``(K, Inertia)``; all fits share every pass."""
    ks = list(range(k_min, k_max + 1))
    _, costs, _ = _fit_all(df, columns, ks, (seed,), max_iter, tol, starts, key)
    best = [(k, min(costs[i * starts + n] for n in range(starts))) for i, k in enumerate(ks)]
    return df.sparkSession.createDataFrame(best, "K int, Inertia double")


def segment(df: DataFrame, id_col: str, model_cols: Sequence[str], reporting_cols: Sequence[str],
            k: int, seeds: Sequence[int] = (42,), max_iter: int = 300, tol: float = 1e-4,
            fill_text: str | None = "0") -> tuple[DataFrame, KMeansFit]:
    """Final segmentation (M7): select, fill 0, standardise, fit, label.

    Returns the client table ``(id, model..., Cluster, reporting...)`` with
    the model columns in their original units, and the fit.
    """
    from segmint.functions.prep import fill_selected, select_variables

    chosen = select_variables(df, id_col, model_cols, reporting_cols)
    model_cols = chosen.columns[1:1 + len(dict.fromkeys(model_cols))]
    reporting_cols = chosen.columns[1 + len(model_cols):]
    written = cut_lineage(fill_selected(chosen, model_cols + reporting_cols, 0, fill_text))
    stats = steady(standard_stats(written, model_cols))
    zs = [f"__z{i}" for i in range(len(model_cols))]
    scaled = _from_files(written.select("*", *[_scaled(c, stats[c]).alias(z) for c, z in zip(model_cols, zs)]))
    fit = fit_kmeans(scaled, zs, k, seeds, max_iter, tol, key=id_col)
    clients = cut_lineage(label(fit, scaled, zs).select(id_col, *model_cols, "Cluster", *reporting_cols))
    release(written)
    return clients, fit
