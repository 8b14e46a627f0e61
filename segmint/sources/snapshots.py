"""Monthly snapshots.

A snapshot store is one Parquet dataset partitioned by ``snap_date``.  Reading
one month is partition pruning; writing one month with dynamic partition
overwrite replaces only that month, so re-running a month is idempotent and a
failed task attempt leaves nothing behind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmint.functions.dates import month_end_of, month_ends


def month_snapshots(trn: DataFrame, as_of=None, months: Iterable[int] = (1, 2, 3),
                    snap_col: str = "snap_date") -> DataFrame:
    """Rows of the month-end snapshots ``months`` back from ``as_of``.

    The reference unions one table-function call per month; one ``isin`` over
    the snapshot column is the same rows from a single scan, and on a store
    partitioned by ``snap_date`` it prunes to exactly those folders.
    """
    ends = month_ends(as_of, tuple(months))
    return trn.where(F.col(snap_col).isin(ends))


def union_months(trn: DataFrame, as_of=None, months: Iterable[int] = (1, 2, 3),
                 snap_col: str = "snap_date") -> DataFrame:
    """Literal UNION ALL form of ``month_snapshots`` (kept for equivalence tests)."""
    parts = [trn.where(F.col(snap_col) == F.lit(month_end_of(as_of, m))) for m in months]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_snapshot(df: DataFrame, root: str, snap_col: str = "snap_date") -> None:
    """Write (or replace) the months present in ``df`` under ``root``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(snap_col).parquet(root)


def read_snapshot(spark: SparkSession, root: str, snap_date, snap_col: str = "snap_date") -> DataFrame:
    """One month of a partitioned snapshot store (S4); the filter prunes folders."""
    return spark.read.parquet(root).where(F.col(snap_col) == F.lit(snap_date))


def snapshot_exists(spark: SparkSession, root: str, snap_date, snap_col: str = "snap_date") -> bool:
    """Whether the month's partition folder holds data (any filesystem scheme).

    Resolving the folder's schema lists its files and reads one footer.  Only a
    missing folder counts as missing: a month that cannot be read is an error,
    never rebuilt over.
    """
    try:
        spark.read.parquet(f"{root}/{snap_col}={snap_date}").schema
        return True
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def snapshot_or_build(spark: SparkSession, root: str, as_of,
                      builder: Callable[[object], DataFrame],
                      snap_col: str = "snap_date") -> DataFrame:
    """Read-through monthly cache.

    If the previous month end is already stored, read it; otherwise build it
    with ``builder(month_end)``, write it, and read the written copy back so
    later work starts from files rather than from the build lineage.
    """
    snap = month_end_of(as_of, 1)
    if not snapshot_exists(spark, root, snap, snap_col):
        built = builder(snap)
        if snap_col not in built.columns:
            built = built.withColumn(snap_col, F.lit(snap))
        write_snapshot(built, root, snap_col)
    return read_snapshot(spark, root, snap, snap_col)
