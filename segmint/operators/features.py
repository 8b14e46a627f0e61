"""Per-customer feature blocks.

Design notes for scale
----------------------
* Pivots are conditional aggregates: ``sum(CASE WHEN class = v THEN x END)``
  for every listed value in ONE ``groupBy(key)``.  That is one shuffle with a
  map-side partial aggregate (a hot customer reaches its reducer as one row
  per map task), and several pivots over the same input share it.  The
  DataFrame ``pivot()`` would first aggregate on ``(key, class)`` and then
  again on ``key``.
* Channel counts and amounts for several channels of one fact table are also
  one conditional aggregate: the fact is read once, not once per channel.
* Money is summed as ``decimal(18,2)``, so totals are exact and the rounding
  of ``round(sum/3, 1)`` is a decimal HALF_UP rounding, not a float one.
* Blocks are joined to the base with ``join(on=key, how="left")``: all blocks
  are grouped by the same key, so the hash partitioning of each aggregate is
  reused by the join and AQE turns small blocks into broadcast joins at run
  time (its size check, not ours).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def category_sums(trn: DataFrame, key: str, class_col: str, categories: Mapping[str, str],
                  cnt_col: str = "cnt", amt_col: str = "amt") -> DataFrame:
    """Pivot of ``sum(cnt)``, ``sum(amt)`` per listed class (A1-A3).

    Output columns ``<ALIAS>_SUM_CNT`` / ``<ALIAS>_SUM_AMT``; a cell without
    rows is null; a key whose rows all have unlisted classes keeps an all-null row.
    """
    aggs = []
    for value, alias in categories.items():
        hit = F.col(class_col) == F.lit(value)
        aggs.append(F.sum(F.when(hit, F.col(cnt_col))).cast("double").alias(f"{alias}_SUM_CNT"))
        aggs.append(F.sum(F.when(hit, F.col(amt_col).cast(MONEY))).cast("double").alias(f"{alias}_SUM_AMT"))
    return trn.groupBy(key).agg(*aggs)


def category_averages(trn: DataFrame, key: str, class_col: str, categories: Mapping[str, str],
                      months: int = 3, cnt_col: str = "cnt", amt_col: str = "amt",
                      names: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """Fixed-denominator monthly averages of the pivot cells.

    ``x / months`` for every cell; null stays null.  The denominator is the
    window length even for customers present in fewer months (quirk Q4).
    ``names`` may override the output names per alias as ``(cnt_name, amt_name)``.
    """
    aggs = []
    for value, alias in categories.items():
        cnt_name, amt_name = (names or {}).get(alias, (f"{alias}_AVG_CNT", f"{alias}_AVG_AMT"))
        hit = F.col(class_col) == F.lit(value)
        aggs.append((F.sum(F.when(hit, F.col(cnt_col))) / F.lit(float(months))).alias(cnt_name))
        aggs.append((F.sum(F.when(hit, F.col(amt_col).cast(MONEY))).cast("double")
                     / F.lit(float(months))).alias(amt_name))
    return trn.groupBy(key).agg(*aggs)


def channel_averages(fact: DataFrame, key: str, channels: Mapping[str, Column],
                     amount: Column | str, months: int = 3, weight: Column | str | None = None,
                     common: Column | None = None, names: Mapping[str, tuple[str, str]] | None = None
                     ) -> DataFrame:
    """Per-customer activity of several channels from one fact, one pass.

    For each channel predicate ``p``:
      ``<cnt> = count(rows with p) / months`` (null when there are none, as the
      left join to a per-channel aggregate would give), and
      ``<amt> = round(sum(amount where p) / months, 1)`` (decimal HALF_UP).
    ``weight`` lets a pre-aggregated fact carry row counts; ``common`` is the
    predicate all channels share, applied before the shuffle together with the
    disjunction of the channel predicates.
    """
    amt = _c(amount).cast(MONEY)
    w = _c(weight) if weight is not None else F.lit(1)
    any_channel = None
    for p in channels.values():
        any_channel = p if any_channel is None else (any_channel | p)
    cond = any_channel if common is None else (common & any_channel)
    aggs = []
    for name, p in channels.items():
        cnt_name, amt_name = (names or {}).get(name, (f"AVG_{name}_CNT", f"AVG_{name}_AMT"))
        n = F.sum(F.when(p, w).otherwise(F.lit(0)))
        aggs.append((F.nullif(n, F.lit(0)) / F.lit(float(months))).alias(cnt_name))
        aggs.append(F.round(F.sum(F.when(p, amt)) / F.lit(months), 1).cast("double").alias(amt_name))
    return fact.where(cond).groupBy(key).agg(*aggs)


def semi_join(base: DataFrame, other: DataFrame, base_key: str, other_key: str | None = None) -> DataFrame:
    """Rows of ``base`` whose key occurs in ``other`` (J3, uncorrelated IN).

    The other side is reduced to distinct keys first: the distinct is combined
    map-side, so a key repeated across a third of all fact rows is shuffled as
    one row per map task, and the join then sees unique keys (its hash
    partitioning is reused by a sort-merge join; small key sets broadcast).
    """
    other_key = other_key or base_key
    keys = other.select(F.col(other_key).alias(base_key)).distinct()
    return base.join(keys, base_key, "left_semi")


def attach(base: DataFrame, key: str, blocks: Iterable[DataFrame], check: bool = False) -> DataFrame:
    """Left-join every block to the base on ``key``.

    Blocks must be unique on ``key`` (they are aggregates or dimension rows);
    a duplicate would multiply base rows, as in the reference (quirk Q12).  With
    ``check`` a repeated key in a block is an error when the result is evaluated:
    for blocks that are read rather than aggregated here.
    """
    out = base
    for b in blocks:
        out = out.join(unique(b, key) if check else b, key, "left")
    return out


def unique(df: DataFrame, key: str) -> DataFrame:
    """``df``, with an error in the plan where ``key`` repeats (Q12); null keys never match and may repeat.

    One aggregate by the key: the join that follows reuses its partitioning, nothing is read twice and no job runs
    before.  The check is part of the row's columns, so it cannot be optimised away while any of them is used.
    """
    rest = [c for c in df.columns if c != key]
    packed = F.struct(*[F.col(f"`{c}`") for c in rest])
    keys = [F.col(key), F.when(F.col(key).isNull(), F.monotonically_increasing_id()).alias("__null")]
    found = df.select("*", keys[1]).groupBy(key, "__null").agg(F.count(F.lit(1)).alias("__n"), F.min(packed).alias("__row"))
    said = F.concat(F.lit(f"{key} repeats: "), F.col(key).cast("string"))
    row = F.when(F.col("__n") > 1, F.raise_error(said).cast(found.schema["__row"].dataType)).otherwise(F.col("__row"))
    return found.select(key, row.alias("__row")).select(*[F.col(key) if c == key else F.col("__row")[c].alias(c) for c in df.columns])


def key_duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
