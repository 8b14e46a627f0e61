"""Writers for the two result files.

The client table (one row per customer) is written from every partition in
parallel; it is never coalesced.  The profile is at most a few hundred cells,
so a single file is allowed for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_client_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Client-level output: id, model columns, Cluster, reporting columns."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def write_profile(df: DataFrame, path: str) -> None:
    """Cluster profile with row labels first (S9).  Small by construction."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Store a fact as a catalogued table bucketed and sorted by ``key``.

    Two tables bucketed by the same key into the same number of buckets are
    joined bucket by bucket: neither side is shuffled for the join.
    """
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
