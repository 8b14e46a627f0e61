"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

The tree has a level for each name in ``levels`` (domain, language, source).  A
node's budget goes to its children in proportion to their weights; a child
takes no more than ``epochs`` times the tokens under it, and what it leaves goes
to its siblings, by weight, until none can take more.  As a node's own limit is
the sum over its leaves, a shortage reaches another branch only where all
siblings are full.  Budgets are whole numbers (rounded down), compared as exact
decimals, so the result does not depend on the order of sums.

A leaf's budget buys whole epochs first, then a prefix of one more epoch: the
documents in the order of md5(seed|epoch|doc_id), as far as their running count
of tokens stays within the rest.  Running counts are two-level: sums of hash
ranges of about ``RANGE_ROWS`` documents first, then within a range, so a leaf
that holds a third of all rows is many tasks.

Defined results
* null names count as the empty name, null texts as empty (no tokens);
* nodes without a stated weight have weight 1; a weight of 0 or less gets nothing;
* repeated rows are rows of their own; ties in the order go by doc_id, then tokens;
* an empty table, or one without tokens, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmint.llm._util import BLANKS, cut

RANGE_ROWS = 5_000
EXACT = "decimal(38,0)"


def n_words(text: str = "text") -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, null as none."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(f"[^{BLANKS}]+")), F.lit(0)).cast("long")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[tuple, int], budget: int, epochs: int) -> DataFrame:
    """``levels`` and budget for each leaf of ``leaves`` (levels, available).  The tables here have a row for each node."""
    spark = leaves.sparkSession
    above: DataFrame | None = None
    for depth in range(1, len(levels) + 1):
        path, parent = list(levels[:depth]), list(levels[:depth - 1])
        nodes = leaves.groupBy(*path).agg((F.sum("available") * epochs).cast(EXACT).alias("limit"))
        stated = [(*k, int(w)) for k, w in weights.items() if len(k) == depth]
        if stated:
            ddl = ", ".join(f"`{c}` string" for c in path) + ", weight long"
            nodes = nodes.join(F.broadcast(spark.createDataFrame(stated, ddl)), path, "left")  # as many rows as are stated
        else:
            nodes = nodes.withColumn("weight", F.lit(None).cast("long"))
        nodes = nodes.withColumn("weight", F.coalesce("weight", F.lit(1))).where("weight > 0 AND limit > 0")
        nodes = nodes.join(above, parent) if above is not None else nodes.withColumn("given", F.lit(budget).cast(EXACT))
        of = Window.partitionBy(*[F.col(c) for c in parent]) if parent else Window.partitionBy(F.lit(0))
        by = of.orderBy(F.col("limit").cast("double") / F.col("weight").cast("double"), levels[depth - 1])
        before = by.rowsBetween(Window.unboundedPreceding, -1)
        nodes = nodes.withColumn("left", F.col("given") - F.coalesce(F.sum("limit").over(before), F.lit(0)))
        nodes = nodes.withColumn("shares", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
        # In order of limit by weight, the full children come first.
        open_ = ((F.col("limit") * F.col("shares")).cast(EXACT) > (F.col("left") * F.col("weight")).cast(EXACT)).cast("int")
        nodes = nodes.withColumn("open", open_)
        nodes = nodes.withColumn("open", F.max("open").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        nodes = nodes.withColumn("rest", F.col("given") - F.coalesce(F.sum(F.when(F.col("open") == 0, F.col("limit"))).over(of), F.lit(0)))
        nodes = nodes.withColumn("shares", F.sum(F.when(F.col("open") == 1, F.col("weight"))).over(of))
        share = F.expr(f"cast((cast(rest * weight AS {EXACT}) - cast(rest * weight AS {EXACT}) % shares) / shares AS {EXACT})")
        nodes = nodes.withColumn("given", F.when(F.col("open") == 0, F.col("limit")).otherwise(share).cast(EXACT))
        above = nodes.select(*path, "given")
    return above.withColumnRenamed("given", "budget")


def select(rows: DataFrame, levels: Sequence[str], weights: Mapping[tuple, int], share: tuple[int, int], epochs: int, seed: int) -> DataFrame:
    """``rows`` (doc_id, levels, n_tokens; a written table) with ``copies``, for those that are taken at all.

    ``share``: the whole budget as a fraction (numerator, denominator) of all tokens.
    """
    levels = list(levels)
    leaves = cut(rows.groupBy(*levels).agg(F.sum("n_tokens").cast(EXACT).alias("available"), F.count("*").alias("n_rows")))
    total = int(leaves.agg(F.sum("available")).first()[0] or 0)
    budgets = leaf_budgets(leaves, levels, weights, total * share[0] // share[1], epochs)
    given = budgets.join(leaves, levels).select(
        *levels, F.expr("cast((budget - budget % available) / available AS int)").alias("full"),
        (F.col("budget") % F.col("available")).cast(EXACT).alias("rest"), F.ceil(F.col("n_rows") / RANGE_ROWS).cast("long").alias("ranges"))
    given = cut(given)
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), (F.col("full") + 1).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    placed = rows.join(given, levels).withColumn("place", order)
    placed = placed.withColumn("range", F.shiftright(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * F.col("ranges"), 32))
    sums = placed.groupBy(*levels, "range").agg(F.sum("n_tokens").cast(EXACT).alias("tokens"))
    sums = sums.select(*levels, "range", F.coalesce(F.sum("tokens").over(
        Window.partitionBy(*levels).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(EXACT).alias("before"))
    running = F.sum("n_tokens").over(Window.partitionBy(*levels, "range").orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    found = placed.withColumn("running", running.cast(EXACT)).join(sums, [*levels, "range"])
    copies = F.col("full") + ((F.col("before") + F.col("running")) <= F.col("rest")).cast("int")
    return found.withColumn("copies", copies).where("copies > 0").select("doc_id", *levels, "n_tokens", "copies")


def named(docs: DataFrame, levels: Mapping[str, Column]) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in levels.items()], n_words().alias("n_tokens"))


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[tuple, int], share: tuple[int, int] = (4, 5), epochs: int = 2, seed: int = 17) -> DataFrame:
    """doc_id, the levels, n_tokens and epoch (from 1): a row for each time that a document is taken."""
    found = select(cut(named(docs, levels)), list(levels), weights, share, epochs, seed)
    return found.select("doc_id", *levels, "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("epoch"))


def take(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[tuple, int], share: tuple[int, int] = (4, 5), epochs: int = 2, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, all columns, as often as ``mix`` takes them.  Rows of the same doc_id are told apart by leaf and tokens."""
    found = select(cut(named(docs, levels)), list(levels), weights, share, epochs, seed)
    same = ["__id", *(f"__{n}" for n in levels), "__n"]
    leaf = {f"__{n}": n for n in levels}
    chosen = found.select(F.col("doc_id").alias("__id"), *[F.col(n).alias(k) for k, n in leaf.items()], F.col("n_tokens").alias("__n"), "copies")
    chosen = chosen.withColumn("__no", F.row_number().over(Window.partitionBy(*same).orderBy(F.desc("copies")))).withColumnRenamed("copies", "__copies")
    own = docs.withColumns({"__id_own": F.col("doc_id").cast("long"), "__n_own": n_words()} | {f"{k}_own": F.coalesce(levels[n].cast("string"), F.lit("")) for k, n in leaf.items()})
    own = own.withColumn("__no_own", F.row_number().over(Window.partitionBy(*[f"{c}_own" for c in same]).orderBy(F.col("text").cast("string"))))
    on = own["__no_own"] == chosen["__no"]
    for c in same:
        on = on & own[f"{c}_own"].eqNullSafe(chosen[c])
    return own.join(chosen, on).withColumn("__epoch", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[own[c] for c in docs.columns])
