"""Statistics: describe, quartiles, shares, correlation, cluster profile
(SURVEY A10-A16, R1-R4, X6, W1).

Design notes for scale
----------------------
* Count, mean, std, min and max are ordinary aggregates: map-side partial
  aggregation, one shuffle, no group held in one task.
* Exact quantiles take two passes at every size.  The first gives, next to the
  moments, approximate percentiles a little below and above each wanted rank;
  their error bound says which pair must enclose the rank.  The second counts
  what lies below the pair and the frequencies of the values inside it: ties
  collapse on the map side, so a value that most rows share is one row per
  task, and only a few thousandths of the values reach the ranking.  Where even
  these are more than ``RANKED`` values of one group, passes of plain counts by
  value range narrow the pair first, so no task ranks more than that.
* Correlation of all pairs takes two passes over the written columns, whatever
  their number and their nulls.  Presence is a 0/1 factor: a task adds up its
  batches as matrices (NumPy over Arrow) and gives one row for each pair, which
  Spark sums.  The first pass gives every pair's own means and ends, the second
  the products about those means, so nothing cancels.  No row is expanded.
* The profile is at most ``k * (2 + 6 * variables)`` cells: it is reshaped
  with Spark (unpivot + pivot), never collected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmint.session import cut_lineage

DEFAULT_PROBS = (0.25, 0.5, 0.75)
# Relative error of the approximate percentiles that bracket a rank, and the distance
# (as a share of the rows) at which the bracket is taken.
ACCURACY = 1000
REACH = 0.002
# Values of one bracket that one task may rank, and into how many ranges a pass cuts a larger bracket.
RANKED = 1 << 20
RANGES = 256


def np_round(col: Column | str, digits: int) -> Column:
    """Round like NumPy's ``round`` (scale, round half to even, unscale).

    NumPy multiplies by ``10**digits`` first, so a value stored as
    2.34500000000000019984 rounds to 2.35; Spark's ``bround`` on the value
    itself would see the decimal text "2.345" and give 2.34.  Rounding the
    scaled product to an integer matches NumPy in both cases.
    """
    c = F.col(col) if isinstance(col, str) else col
    scale = float(10 ** digits)
    return F.bround(c * F.lit(scale), 0) / F.lit(scale)


def to_long(df: DataFrame, ids: Sequence[str], variables: Sequence[str],
            var_name: str = "variable", value_name: str = "value") -> DataFrame:
    """Unpivot ``variables`` (cast to double) into ``(ids..., variable, value)``."""
    cast = df.select(*ids, *[F.col(v).cast("double").alias(v) for v in variables])
    return cast.unpivot(list(ids), list(variables), var_name, value_name)


def _sketch(value: Column, probs: Sequence[float]) -> Column:
    """Approximate percentiles a little below and above every probability."""
    ps = [min(1.0, max(0.0, p + side * REACH)) for p in probs for side in (-1, 1)]
    return F.percentile_approx(value, ps, ACCURACY)


def _bracket(sketch: Column, i: int, n: Column, least: Column, most: Column) -> Column:
    """``struct(lo, hi)`` that encloses ranks floor(p(n-1)) and the next, for the i-th probability.

    A sketch value misses its rank by n / ACCURACY at most; two ranks more
    cover the rounding.  Small groups take all their values.
    """
    return F.when(n * F.lit(REACH) >= n / F.lit(float(ACCURACY)) + F.lit(2.0), F.struct(sketch[2 * i].alias("lo"), sketch[2 * i + 1].alias("hi"))
                  ).otherwise(F.struct(least.alias("lo"), most.alias("hi")))


def _cells(df: DataFrame, groups: list[str], variables: list[str], probs: Sequence[float], brackets: DataFrame) -> DataFrame:
    """``(groups..., i, j, lo, hi, v)`` of every row up to the bracket's upper end."""
    left = df.select(*[F.col(g).alias(f"__g{k}") for k, g in enumerate(groups)], *[F.col(v).cast("double").alias(f"__v{i}") for i, v in enumerate(variables)])
    on = F.lit(True)
    for k, g in enumerate(groups):  # a null group is a group
        on = on & left[f"__g{k}"].eqNullSafe(brackets[g])
    cells = []
    for i in range(len(variables)):
        v = F.col(f"__v{i}")
        for j in range(len(probs)):
            b = F.col(f"b{i}_{j}")
            cells.append(F.when(v <= b["hi"], F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), b["lo"].alias("lo"), b["hi"].alias("hi"), v.alias("v"))))
    return left.join(brackets, on).select(*groups, F.inline(F.array(*cells))).where("i IS NOT NULL")


def _with_ranks(found: DataFrame, groups: list[str], variables: list[str], probs: Sequence[float], brackets: DataFrame) -> DataFrame:
    """``found`` (groups, i, j, ...) with ``__n``, ``__h = p (n - 1)``, the rank ``__lo`` below it and the next one ``__hi``."""
    sizes = brackets.select(*[F.col(g).alias(f"__g{k}") for k, g in enumerate(groups)], F.posexplode(F.array(*[F.col(f"n{i}") for i in range(len(variables))])).alias("__i", "__n"))
    on = F.col("i") == F.col("__i")
    for k, g in enumerate(groups):
        on = on & found[g].eqNullSafe(sizes[f"__g{k}"])
    wanted = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("j") + 1) * (F.col("__n") - 1)
    out = found.join(sizes, on).withColumn("__h", wanted).withColumn("__lo", F.floor("__h"))
    return out.withColumn("__hi", F.least(F.col("__lo") + 1, F.col("__n") - 1))


def _narrow(df: DataFrame, groups: list[str], variables: list[str], probs: Sequence[float], brackets: DataFrame) -> DataFrame:
    """``brackets`` so narrow that each holds ``RANKED`` rows at most, or one value, or the two values next to each other that are wanted.

    A pass counts the rows of every bracket in ``RANGES`` equal ranges of values (partial counts: as many rows a task
    as there are ranges) and takes the range that holds both ranks.  Where they lie in two ranges, they are the last
    value of the one and the first of the other.  The ends of a bracket fall into different ranges, so every pass narrows it.
    """
    most = brackets.agg(F.max(F.greatest(*[F.col(f"n{i}") for i in range(len(variables))], F.lit(0)))).first()[0] or 0
    inside = min(most, most * (2 * REACH + 2 / ACCURACY) + 4) if most * REACH >= most / ACCURACY + 2 else most
    while inside > RANKED:
        cells = _cells(df, groups, variables, probs, brackets)
        at = F.when(F.col("v") < F.col("lo"), -1).when(F.col("hi") > F.col("lo"), F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * RANGES)).otherwise(0)
        counts = cells.withColumn("at", at.cast("int")).groupBy(*groups, "i", "j", "at").agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("least"), F.max("v").alias("most"))
        counts = counts.withColumn("upto", F.sum("m").over(Window.partitionBy(*groups, "i", "j").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
        ranked = _with_ranks(counts, groups, variables, probs, brackets).where("at >= 0")
        part = F.struct("at", "least", "most", "m")
        picked = ranked.groupBy(*groups, "i", "j").agg(F.min(F.when(F.col("upto") > F.col("__lo"), part)).alias("a"), F.min(F.when(F.col("upto") > F.col("__hi"), part)).alias("b"))
        same = F.col("a.at") == F.col("b.at")
        picked = picked.select(*groups, "i", "j", F.struct(F.when(same, F.col("a.least")).otherwise(F.col("a.most")).alias("lo"),
                                                           F.when(same, F.col("a.most")).otherwise(F.col("b.least")).alias("hi")).alias("b"),
                               F.when(same & (F.col("a.least") < F.col("a.most")), F.col("a.m")).otherwise(0).alias("m"))
        wide = picked.groupBy(*groups).agg(F.max("m").alias("__most"), *[F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("b"))).alias(f"__b{i}_{j}")
                                                                         for i in range(len(variables)) for j in range(len(probs))])
        wide = wide.select(*[F.col(g).alias(f"__g{k}") for k, g in enumerate(groups)], *[c for c in wide.columns if c not in groups])
        on = F.lit(True)
        for k, g in enumerate(groups):
            on = on & brackets[g].eqNullSafe(wide[f"__g{k}"])
        joined = cut_lineage(brackets.join(wide, on, "left"))
        inside = joined.agg(F.max("__most")).first()[0] or 0
        names = [f"b{i}_{j}" for i in range(len(variables)) for j in range(len(probs))]
        brackets = joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in names else F.col(c) for c in brackets.columns])
    return brackets


def _ranked(df: DataFrame, groups: list[str], variables: list[str], probs: Sequence[float], brackets: DataFrame) -> DataFrame:
    """``(groups..., i, j, q)``: the j-th quantile of the i-th variable, from rows and ``brackets`` (groups, n0.., b0_0..)."""
    brackets = _narrow(df, groups, variables, probs, brackets)
    inside = F.col("v") >= F.col("lo")
    found = _cells(df, groups, variables, probs, brackets).select(*groups, "i", "j", inside.alias("inside"), F.when(inside, F.col("v")).alias("v"))
    found = found.groupBy(*groups, "i", "j", "inside", "v").agg(F.count(F.lit(1)).alias("m"))
    order = Window.partitionBy(*groups, "i", "j").orderBy("inside", "v").rowsBetween(Window.unboundedPreceding, 0)
    found = _with_ranks(found.withColumn("upto", F.sum("m").over(order)), groups, variables, probs, brackets)
    picked = found.groupBy(*groups, "i", "j").agg(
        F.min(F.when(F.col("inside") & (F.col("upto") > F.col("__lo")), F.col("v"))).alias("a"),
        F.min(F.when(F.col("inside") & (F.col("upto") > F.col("__hi")), F.col("v"))).alias("b"),
        F.min(F.when(~F.col("inside"), F.col("upto"))).alias("below"), F.first("__lo").alias("lo"), F.first(F.col("__h") - F.col("__lo")).alias("frac"))
    enclosed = (F.coalesce("below", F.lit(0)) <= F.col("lo")) & F.col("a").isNotNull() & F.col("b").isNotNull()
    value = F.when(enclosed, F.col("a") + (F.col("b") - F.col("a")) * F.col("frac")).otherwise(F.raise_error(F.lit("a quantile's rank is outside its bracket")).cast("double"))
    return picked.select(*groups, "i", "j", value.alias("q"))


def _moments(df: DataFrame, groups: list[str], variables: list[str], probs: Sequence[float]) -> DataFrame:
    """First pass: per group and variable i the count ``n<i>``, moments, least, most and brackets ``b<i>_<j>``."""
    aggs = []
    for i, v in enumerate(variables):
        x = F.col(v).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"), F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"),
                 _sketch(x, probs).alias(f"s{i}")]
    out = df.groupBy(*groups).agg(*aggs)
    for i in range(len(variables)):
        for j in range(len(probs)):
            out = out.withColumn(f"b{i}_{j}", _bracket(F.col(f"s{i}"), j, F.col(f"n{i}"), F.col(f"min{i}"), F.col(f"max{i}")))
    return cut_lineage(out.drop(*[f"s{i}" for i in range(len(variables))]))


def exact_quantiles(long_df: DataFrame, groups: Sequence[str], value: str = "value",
                    probs: Sequence[float] = DEFAULT_PROBS) -> DataFrame:
    """Exact linear-interpolation quantiles per group (pandas ``describe``).

    Returns ``(groups..., p, q)``.  Nulls are ignored, a null group is a group
    like any other; a group's quantile at ``p`` is ``v[lo] + (v[lo+1] - v[lo]) *
    frac`` with ``h = p*(n-1)``.
    """
    groups = list(groups)
    rows = long_df.where(F.col(value).isNotNull()).withColumn("__all", F.lit(0))
    keys = groups or ["__all"]
    brackets = _moments(rows, keys, [value], probs)
    p = F.element_at(F.array(*[F.lit(float(x)) for x in probs]), F.col("j") + 1)
    return _ranked(rows, keys, [value], probs, brackets).select(*groups, p.alias("p"), "q")


def describe_by(df: DataFrame, group: str, variables: Sequence[str],
                probs: Sequence[float] = DEFAULT_PROBS) -> DataFrame:
    """``groupby(group).describe()`` in long form (A10).

    Columns: ``variable, <group>, count, mean, std, min, p25, p50, p75, max``
    (std is the sample std, ddof 1; quartiles are exact and linear; nulls are
    ignored per variable).  Every group has a row for every variable: one whose
    values are all null has count 0 and null statistics.  Two passes over
    ``df``, whatever its size.
    """
    variables = list(variables)
    first = _moments(df, [group], variables, probs)
    ranked = _ranked(df, [group], variables, probs, first)
    names = [f"p{int(round(p * 100))}" for p in probs]
    wide = ranked.groupBy(group, "i").agg(*[F.max(F.when(F.col("j") == j, F.col("q"))).alias(n) for j, n in enumerate(names)])
    wide = wide.select(F.col(group).alias("__g"), F.col("i").alias("__i"), *names)
    long = first.select(group, F.posexplode(F.array(*[F.struct(*[F.col(f"{c}{i}").alias(n) for c, n in (("n", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("max", "max"))])
                                                      for i in range(len(variables))])).alias("i", "x"))
    out = long.join(wide, long[group].eqNullSafe(wide["__g"]) & (F.col("i") == F.col("__i")), "left")
    variable = F.element_at(F.array(*[F.lit(v) for v in variables]), F.col("i") + 1)
    return out.select(variable.alias("variable"), group, "x.count", "x.mean", "x.std", "x.min", *names, "x.max")


def cluster_share(labelled: DataFrame, cluster: str = "Cluster", digits: int = 2) -> DataFrame:
    """Cluster size and its share of all rows in percent.

    The window has no partition key, but it runs over the k aggregated rows
    only (k <= 30), never over customer rows.
    """
    sizes = labelled.groupBy(cluster).agg(F.count(F.lit(1)).alias("Count"))
    total = F.sum("Count").over(Window.partitionBy())
    return sizes.select(cluster, "Count",
                        np_round(F.lit(100.0) * F.col("Count") / total, digits).alias("CountShare"))


def population_metrics(df: DataFrame) -> DataFrame:
    """Rows and variables of a frame (A11): ``(n_rows, n_columns)``."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Values (0 where null) and presence of the columns, up to 2,048 rows at a time."""
    for whole in batches:
        for k in range(0, whole.num_rows, 2048):
            b = whole.slice(k, 2048)
            here = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in b.columns], axis=1)
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)
            yield np.where(here, x, 0.0), here


def _per_pair(data: DataFrame, names: Sequence[str], task, whole: str) -> DataFrame:
    """Rows ``(x, y, names...)`` of every task: ``task`` turns its blocks into a matrix for each name."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = task(_blocks(batches))
        n = len(found[0])
        x, y = np.divmod(np.arange(n * n, dtype=np.int32), np.int32(n))
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), *[pa.array(m.ravel().astype(float)) for m in found]], names=["x", "y", *names])

    return data.mapInArrow(run, f"x int, y int, {', '.join(f'{c} double' for c in names)}").where(whole)


def _pair_means(data: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``mean[i, j]`` of column i over the rows that have both, and whether i varies in them: n x n numbers on the driver."""
    def task(blocks):
        rows, sums = np.zeros((n, n)), np.zeros((n, n))
        least, most = np.full((n, n), np.inf), np.full((n, n), -np.inf)
        for x, here in blocks:
            rows += here.T.astype(float) @ here
            sums += x.T @ here
            low, high = np.where(here, x, np.inf), np.where(here, x, -np.inf)
            for j in range(n):
                own = here[:, j]
                if own.any():
                    least[:, j] = np.minimum(least[:, j], low[own].min(axis=0))
                    most[:, j] = np.maximum(most[:, j], high[own].max(axis=0))
        return rows, sums, least, most

    found = _per_pair(data, ["n", "s", "lo", "hi"], task, "n > 0").groupBy("x", "y").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    mean, varies = np.zeros((n, n)), np.zeros((n, n), dtype=bool)
    for r in found:
        mean[r["x"], r["y"]], varies[r["x"], r["y"]] = r["s"] / r["n"], r["lo"] < r["hi"]
    return mean, varies


def correlation_long(df: DataFrame, variables: Sequence[str], lower_only: bool = False,
                     digits: int | None = 2) -> DataFrame:
    """Pairwise-complete Pearson correlation of all pairs, long form (A13, A14), for any number of columns.

    The columns are written once.  The first pass takes every pair's own means (over the rows that have both
    columns), the second the squares and products about them; a last correction removes what rounding left of the
    sums.  Neither depends on how many patterns of nulls there are.

    A column that is constant over a pair's rows gives null instead of an ANSI
    divide-by-zero error (trap T1); so does a pair with a NaN or an infinite value.  ``lower_only`` keeps pairs on or below the
    diagonal (the heat map's mask).  Output ``(var_x, var_y, r)``; ``var_x`` is the
    row, ``var_y`` the column.  ``digits=None`` leaves r unrounded.
    """
    variables = list(dict.fromkeys(variables))
    n = len(variables)
    spark = df.sparkSession
    data = cut_lineage(df.select(*[F.col(v).cast("double").alias(f"x{i}") for i, v in enumerate(variables)]))
    mean, varies = _pair_means(data, n)

    def task(blocks):
        out = [np.zeros((n, n)) for _ in range(6)]
        with np.errstate(invalid="ignore", over="ignore"):
            for x, here in blocks:
                for j in range(n):
                    own = here[:, j]
                    if not own.any():
                        continue
                    both = here[own]
                    dx = np.where(both, x[own] - mean[:, j], 0.0)                    # of every column about its mean beside j
                    dy = np.where(both, x[own, j][:, None] - mean[j, :], 0.0)         # of j about its mean beside every column
                    for m, v in zip(out, (both, dx, dy, dx * dx, dy * dy, dx * dy)):
                        m[:, j] += v.sum(axis=0)
        return out

    names = ["m", "sx", "sy", "xx", "yy", "xy"]
    none = spark.range(n * n).select(F.expr(f"CAST(id DIV {n} AS int)").alias("x"), F.expr(f"CAST(id % {n} AS int)").alias("y"), *[F.lit(0.0).alias(c) for c in names])
    pairs = _per_pair(data, names, task, "m > 0 AND x <= y").unionByName(none.where("x <= y")).groupBy("x", "y").agg(*[F.sum(c).alias(c) for c in names])
    m, sx, sy, xx, yy, xy = map(F.col, names)
    count = F.nullif(m, F.lit(0.0))
    vx, vy = xx - sx * sx / count, yy - sy * sy / count
    r = (xy - sx * sy / count) / F.nullif(F.sqrt(vx) * F.sqrt(vy), F.lit(0.0))
    flags = varies & varies.T
    changing = F.array(*[F.lit("".join("1" if v else "0" for v in row)) for row in flags])  # a text for each column
    r = F.when((F.substring(changing[F.col("x")], F.col("y") + 1, F.lit(1)) == "1") & ~F.isnan(r), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    per_pair = pairs.select("x", "y", (np_round(r, digits) if digits is not None else r).alias("r"))
    labels = F.array(*[F.lit(v) for v in variables])
    a, b = labels[F.col("x")], labels[F.col("y")]
    below = F.struct(b.alias("var_x"), a.alias("var_y"), F.col("r"))
    if lower_only:
        return per_pair.select(F.inline(F.array(below)))
    above = F.struct(a.alias("var_x"), b.alias("var_y"), F.col("r"))
    return per_pair.select(F.inline(F.when(F.col("x") == F.col("y"), F.array(below)).otherwise(F.array(below, above))))


def redundant_pairs(corr: DataFrame, threshold: float = 0.8, digits: int | None = None) -> DataFrame:
    """Pairs whose correlation is above ``threshold`` or below its negative.

    Give it unrounded correlations (``correlation_long(..., digits=None)``); the
    test is on r itself, ``digits`` rounds what is shown.  Each unordered pair
    appears once (``var_x`` after ``var_y`` in input order when the input is a
    lower triangle).
    """
    out = corr.where((F.col("var_x") != F.col("var_y"))
                     & ((F.col("r") > threshold) | (F.col("r") < -threshold)))
    return out if digits is None else out.withColumn("r", np_round(F.col("r"), digits))


PROFILE_STATS = ("mean", "min", "p25", "p50", "p75", "max")
PROFILE_LABELS = {"mean": "mean", "min": "min", "p25": "25%", "p50": "50%", "p75": "75%", "max": "max"}


def profile_long(labelled: DataFrame, variables: Sequence[str], cluster: str = "Cluster",
                 digits: int = 2, with_std: bool = False) -> DataFrame:
    """Cluster profile as ``(row_order, row_label, <cluster>, value)``.

    Rows: ``Count``, ``CountShare %``, then per variable ``<var>_mean``,
    ``_min``, ``_25%``, ``_50%``, ``_75%``, ``_max`` (``_std`` on request, Q14).
    ``Count`` is the first variable's count, as in the reference (R3); the
    share is ``100 * Count / sum(Count)`` over the k cluster rows.  Values are
    rounded like NumPy to ``digits``.
    """
    variables = list(variables)
    stats = list(PROFILE_STATS)
    labels = dict(PROFILE_LABELS)
    if with_std:
        stats.insert(1, "std")
        labels["std"] = "std"
    desc = cut_lineage(describe_by(labelled, cluster, variables))      # read twice below: k x variables rows
    order = F.create_map(*[x for i, v in enumerate(variables) for x in (F.lit(v), F.lit(i))])
    cells = desc.select(
        cluster, "variable",
        F.inline(F.array(*[F.struct(F.lit(i).alias("__s"), F.lit(labels[s]).alias("__label"),
                                    F.col(s).alias("value")) for i, s in enumerate(stats)])))
    cells = cells.select(
        (F.lit(2) + order[F.col("variable")] * F.lit(len(stats)) + F.col("__s")).cast("int").alias("row_order"),
        F.concat_ws("_", F.col("variable"), F.col("__label")).alias("row_label"),
        F.col(cluster).cast("int").alias(cluster),
        np_round(F.col("value"), digits).alias("value"))
    sizes = desc.where(F.col("variable") == F.lit(variables[0])).select(cluster, "count")
    # One row per cluster: k of them.
    share = np_round(F.lit(100.0) * F.col("count") / F.nullif(F.sum("count").over(Window.partitionBy()), F.lit(0)), digits)
    sizes = sizes.select(cluster, "count", share.alias("__share"))
    share = F.col("__share")
    head = sizes.select(F.col(cluster).cast("int").alias(cluster), F.inline(F.array(
        F.struct(F.lit(0).alias("row_order"), F.lit("Count").alias("row_label"),
                 F.col("count").cast("double").alias("value")),
        F.struct(F.lit(1).alias("row_order"), F.lit("CountShare %").alias("row_label"),
                 share.alias("value")))))
    return head.select("row_order", "row_label", cluster, "value").unionByName(cells)


def profile_wide(long: DataFrame, k: int, cluster: str = "Cluster") -> DataFrame:
    """Transpose the long profile to one column per cluster ``"0"`` ... ``"k-1"``.

    Explicit pivot values: a cluster without rows (k above the number of
    distinct points, trap T9) becomes a null column instead of vanishing.  A
    label outside 0..k-1 (or null) has no column to go to and is an error.
    """
    outside = ~F.coalesce(F.col(cluster).isin(list(range(k))), F.lit(False))
    refuse = F.raise_error(F.concat(F.lit(f"label outside 0..{k - 1}: "), F.coalesce(F.col(cluster).cast("string"), F.lit("null")))).cast("double")
    value = F.when(outside, refuse).otherwise(F.col("value"))
    cells = [F.max(F.when(outside | (F.col(cluster) == F.lit(i)), value)).alias(str(i)) for i in range(k)]
    return long.groupBy("row_order", "row_label").agg(*cells)
