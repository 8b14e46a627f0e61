"""Embedding whitening by incremental eigendecomposition.

Entries become whole numbers x = floor(scale * c) + offset, so that counts, sums
and deviations are exact.  The eigenvectors of the covariance are found in three steps:

1. *Partitions.*  Every task keeps the spectrum (eigenvalues and vectors) of the
   scatter of its rows about their mean.  A row changes it by one symmetric
   rank-one term, centred before it is multiplied: n / (n + 1) (x - m)(x - m)'.
   The new eigenvalues are the roots of the secular equation between the old
   ones; equal poles and directions without weight are deflated first; the new
   vectors follow from the weights that have exactly these roots, so they stay orthogonal.
2. *Merging.*  Spectra are combined in groups of 16, in rounds: the eigenvectors
   of one are rank-one terms of the other, and so is the difference of the means.
3. *Refinement.*  The basis is orthonormalised; a distributed pass takes the
   covariance in it, about the exact means, and its small eigenproblem (Rayleigh-Ritz)
   turns the basis into eigenvectors to double precision.

A last pass projects every row.  Its result is written once, and the covariance
of the whitened values is an aggregate of that table.

A task holds one spectrum (d * d doubles) and a batch of rows; the driver holds one.
A row costs about d * d * d multiplications.

Defined results
* vectors that are null, empty, or hold null or non-finite entries take no part; neither do entries of
  2^52 / scale or more, whose whole number a double could not hold;
* the dimension is the length that most of the remaining rows have (ties: the longer); others take no part;
* repeated rows and null ids count as rows of their own;
* directions without variance (at most d * 2^-52 of the largest) cannot be whitened and have no rows: fewer
  components than asked for are returned if the rows span fewer, none if all rows are equal;
* a deviation above the range of a long is null;
* an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmint.llm._util import arrow_schema, cut
from segmint.session import release

#: Spectra merged by one task in a round.
FAN = 16
EPS = float(np.finfo(float).eps)
LONGEST = 2**63 - 1


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of f(r) = 1 + sum(weights / (poles - r)) for rising poles and positive weights.

    Returns each root and the matrix of poles - roots (pole by row).  A root is held as the distance from the
    nearer pole, so that differences to the poles keep full relative precision.  A step matches value and slope of the
    terms left and right of the root with one term each at the two poles beside it (beyond the last pole: with one
    term) and goes to that function's root; where it leaves the bracket, the bracket is halved.
    """
    k = len(poles)
    each = np.arange(k)
    ends = np.append(poles[1:], poles[-1] + weights.sum())
    middle = (poles + ends) / 2
    left = 1 + (weights[:, None] / (poles[:, None] - middle)).sum(axis=0) >= 0
    left[-1] = True
    near = each + ~left
    origin = poles[near]
    low = np.where(left, 0.0, middle - origin)
    high = np.where(left, middle - origin, 0.0)
    high[-1] = weights.sum()
    delta = poles[:, None] - origin
    below = np.triu(np.ones((k, k)))  # pole i at or left of root j
    following = np.minimum(each + 1, k - 1)
    column = weights[:, None]
    at = (low + high) / 2
    for _ in range(100):
        gap = delta - at
        part = column / gap
        slopes = part / gap
        total, psi = part.sum(axis=0), np.einsum("ij,ij->j", part, below)
        rise, rise_left = slopes.sum(axis=0), np.einsum("ij,ij->j", slopes, below)
        f = 1 + total
        low, high = np.where(f > 0, low, at), np.where(f > 0, at, high)
        one, two = gap[each, each], gap[following, each]
        c = f - one * rise_left - two * (rise - rise_left)
        a, b = (one + two) * f - one * two * rise, one * two * f
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = one[-1] + rise[-1] * one[-1] ** 2 / (f[-1] - rise[-1] * one[-1])
            new = at + step
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        # f is as small as rounding of its terms allows, or the step is below the last digit
        done = (np.abs(f) <= 2 * EPS * (1 + total - 2 * psi)) | (np.abs(new - at) <= 2 * EPS * np.abs(at)) | (high - low <= 2 * EPS * np.abs(at))
        at = np.where(done, at, new)
        if done.all():
            break
    return origin + at, delta - at


def rank_one(values: np.ndarray, vectors: np.ndarray, rho: float, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum (values rising, vectors in columns) of V diag(values) V' + rho u u', rho > 0."""
    z = vectors.T @ u
    size = float(z @ z)
    if not rho * size > 0:
        return values, vectors
    z, rho = z / math.sqrt(size), rho * size
    small = 8 * EPS * max(abs(values[0]), abs(values[-1]), rho)
    vectors = vectors.copy()
    # Equal poles: a reflection turns the weight of each group into its first direction.
    edges = np.flatnonzero(np.concatenate([[True], np.diff(values) > small, [True]]))
    for a, b in zip(edges, edges[1:]):
        if b - a > 1:
            w = z[a:b].copy()
            length = math.sqrt(float(w @ w))
            if length > 0:
                sign = 1.0 if w[0] >= 0 else -1.0
                w[0] += sign * length
                vectors[:, a:b] -= np.outer(vectors[:, a:b] @ w, 2 * w / float(w @ w))
                z[a:b] = 0.0
                z[a] = -sign * length
    active = np.flatnonzero(rho * np.abs(z) > small)
    if not len(active):
        return values, vectors
    poles, weights = values[active], rho * z[active] ** 2
    roots, gaps = secular_roots(poles, weights)
    # Weights that have exactly these roots (Loewner), so that the vectors are orthogonal to working precision.
    apart = poles - poles[:, None]
    np.fill_diagonal(apart, 1.0)
    fitted = np.sqrt(np.abs(np.prod(-gaps / apart, axis=1))) * np.sign(z[active])
    turned = fitted[:, None] / gaps
    turned /= np.sqrt((turned ** 2).sum(axis=0))
    values = values.copy()
    values[active], vectors[:, active] = roots, vectors[:, active] @ turned
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Scatter of n rows about their mean, as eigenvalues and vectors."""
    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, d: int) -> Spectrum:
        return cls(0, np.zeros(d), np.zeros(d), np.eye(d))

    def _term(self, weight: float, u: np.ndarray) -> None:
        self.values, self.vectors = rank_one(self.values, self.vectors, weight, u)

    def add(self, row: np.ndarray) -> None:
        u = row - self.mean
        self._term(self.n / (self.n + 1), u)
        self.n += 1
        self.mean = self.mean + u / self.n

    def merge(self, other: Spectrum) -> None:
        if not other.n:
            return
        for weight, u in zip(other.values, other.vectors.T):
            if weight > 0:
                self._term(weight, u)
        u, n = other.mean - self.mean, self.n + other.n
        self._term(self.n * other.n / n, u)
        self.mean = self.mean + u * (other.n / n)
        self.n = n

    def row(self) -> dict:
        return {"n": self.n, "mean": self.mean, "eigenvalues": self.values, "eigenvectors": self.vectors.ravel()}

    @classmethod
    def of(cls, row) -> Spectrum:
        d = len(row["mean"])
        return cls(row["n"], np.array(row["mean"]), np.array(row["eigenvalues"]), np.array(row["eigenvectors"]).reshape(d, d))


@dataclass(frozen=True)
class Whitening:
    """A fitted transformation: exact number of rows and sums, components in columns by falling eigenvalue."""
    scale: int
    offset: int
    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return x - np.array([s // self.n for s in self.sums]) - np.array([s % self.n / self.n for s in self.sums])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum (n x - S)^2 of every row, exactly."""
        most = max(map(abs, self.sums)) + self.n * max(int(np.abs(x).max(initial=0)), 1)
        sums = np.array(self.sums, dtype=np.int64 if most < LONGEST else object)
        t = (x if most < LONGEST else x.astype(object)) * self.n - sums
        if int(np.abs(t).max(initial=0)) <= math.isqrt(LONGEST // len(self.sums)):
            return (t ** 2).sum(axis=1).tolist()
        return [v if v <= LONGEST else None for v in (t.astype(object) ** 2).sum(axis=1).tolist()]


def usable(vectors: DataFrame, id_col: str, column: str, scale: int) -> DataFrame:
    """id and entries (array of doubles) of the rows that take part, whatever their length."""
    entries = F.col(column).cast("array<double>")
    sound = F.forall("entries", lambda c: c.isNotNull() & (F.abs(c) < float(2**52 // scale)))
    return vectors.select(F.col(id_col).alias("id"), entries.alias("entries")).where((F.size("entries") > 0) & sound)


def _numbers(batch: pa.RecordBatch, d: int, scale: int) -> np.ndarray:
    """floor(scale * c) of the rows of a batch, as whole numbers."""
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.floor(flat * float(scale)).astype(np.int64)


def fit(rows: DataFrame, d: int, scale: int, offset: int) -> Whitening:
    """All eigenvectors of the covariance of ``rows`` (see :func:`usable`), each of ``d`` entries."""
    ddl = "part long, n long, sums array<decimal(38,0)>, mean array<double>, eigenvalues array<double>, eigenvectors array<double>"
    schema = arrow_schema(rows.sparkSession, ddl)

    def record(part: int, sums: list[int], spectrum: Spectrum) -> pa.RecordBatch:
        row = spectrum.row() | {"part": part, "sums": sums}
        return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum, sums = Spectrum.empty(d), [0] * d
        for whole in batches:
            for k in range(0, whole.num_rows, 512):  # 512 numbers below 2^52 add up to a long
                x = _numbers(whole.slice(k, 512), d, scale)
                sums = [a + b for a, b in zip(sums, x.sum(axis=0).tolist())]
                for row in x.astype(float):
                    spectrum.add(row)
        if spectrum.n:
            yield record(TaskContext.get().partitionId(), sums, spectrum)

    def merge(table: pa.Table) -> pa.Table:
        total, sums = Spectrum.empty(d), [0] * d
        listed = sorted(table.to_pylist(), key=lambda r: r["part"])
        for row in listed:
            total.merge(Spectrum.of(row))
            sums = [a + int(b) for a, b in zip(sums, row["sums"])]
        return pa.Table.from_batches([record(listed[0]["part"] // FAN, sums, total)])

    spectra = cut(rows.mapInArrow(update, ddl))
    last = spectra.agg(F.max("part")).first()[0]
    while last is not None and last > 0:
        merged = cut(spectra.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(merge, ddl))
        release(spectra)
        spectra, last = merged, last // FAN
    total = spectra.first()
    release(spectra)
    if total is None:
        return Whitening(scale, offset, 0, (0,) * d, np.eye(d), np.zeros(d), 0.0)
    basis = np.linalg.qr(Spectrum.of(total).vectors)[0]
    own = Whitening(scale, offset, total["n"], tuple(int(s) + total["n"] * offset for s in total["sums"]), basis, np.zeros(d), 0.0)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = np.zeros((d, d))
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                y = own.centred(_numbers(whole.slice(k, 512), d, scale) + offset) @ basis
                h += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([h.ravel()], pa.list_(pa.float64()))], names=["products"])

    sums = rows.mapInArrow(products, "products array<double>").select(F.posexplode("products").alias("place", "v")).groupBy("place").agg(F.sum("v").alias("v"))
    h = np.zeros(d * d)
    for row in sums.collect():  # d * d numbers
        h[row["place"]] = row["v"]
    values, turn = np.linalg.eigh(h.reshape(d, d) / own.n)
    return Whitening(scale, offset, own.n, own.sums, (basis @ turn)[:, ::-1], values[::-1], float(values.sum()))


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, offset: int = 100_000, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error of every row that takes part and every component."""
    ddl = "id long, deviation long, projected array<double>"
    rows = usable(vectors, id_col, column, scale)
    common = rows.groupBy(F.size("entries").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common["d"] if common else 1
    rows = rows.where(F.size("entries") == d).select(F.col("id").cast("long"), "entries")
    model = fit(rows, d, scale, offset)
    k = int(np.count_nonzero(model.eigenvalues[:components] > d * EPS * max(model.eigenvalues[0], 0.0)))
    axes = model.components[:, :k] / np.sqrt(model.eigenvalues[:k])
    schema = arrow_schema(vectors.sparkSession, ddl)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows if k else 0, 512):
                b = whole.slice(at, 512)
                x = _numbers(b, d, scale) + offset
                y = model.centred(x) @ axes
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(model.deviations(x), pa.int64()), pa.array(list(y), pa.list_(pa.float64()))], schema=schema)

    found = cut(rows.mapInArrow(project, ddl))
    error = _identity_error(found, k, model.n)
    parts = F.array(*[F.struct(F.lit(c + 1).alias("component"), F.get("projected", F.lit(c)).alias("whitened"),
                               F.lit(float(model.eigenvalues[c] / model.trace)).alias("explained")) for c in range(max(k, 1) if model.trace else 0)] or
                    [F.struct(F.lit(1).alias("component"), F.lit(0.0).alias("whitened"), F.lit(0.0).alias("explained"))])
    return (found.select("id", "deviation", F.explode(parts).alias("c"))
            .select(F.col("id").alias(id_col), "c.component", F.lit(model.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained",
                    F.lit(error).alias("identity_error")))


def _identity_error(found: DataFrame, k: int, n: int) -> float:
    """Largest absolute entry of the covariance of the written projections minus the identity, about their means."""
    if not k:
        return 0.0
    at = [F.get("projected", F.lit(c)) for c in range(k)]
    means = found.agg(*[F.avg(a).alias(f"m{c}") for c, a in enumerate(at)]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = found.agg(*[F.sum((at[i] - means[i]) * (at[j] - means[j])).alias(f"p{i}_{j}") for i, j in pairs]).first()
    return max(abs(s / n - (i == j)) for s, (i, j) in zip(sums, pairs))
