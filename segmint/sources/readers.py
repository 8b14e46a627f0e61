"""Table readers.

* Parquet is the default: filters and projections written after the read are
  pushed into the scan by Catalyst.
* JDBC reads are split into parallel range reads instead of one cursor feeding one
  client: even ranges between given bounds, or equally deep ranges found in the data.
* CSV always takes an explicit schema: inference costs a full extra pass and
  can guess differently per file.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmint.functions.prep import nan_to_null


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table ``<root>/<name>.parquet`` (file or folder)."""
    return spark.read.parquet(os.path.join(root, f"{name}.parquet"))


def jdbc_options(url: str, table: str | None = None, query: str | None = None,
                 partition_column: str | None = None, lower_bound: int | None = None,
                 upper_bound: int | None = None, num_partitions: int | None = None,
                 fetch_size: int = 10_000, **extra: str) -> dict[str, str]:
    """Options for a partitioned JDBC read.

    With ``partition_column`` and bounds, Spark issues ``num_partitions``
    range queries in parallel, one per task; ``fetch_size`` sets the rows per
    round trip.  ``query`` and a partition column cannot be combined by the
    JDBC source, so a query is wrapped as a derived table.
    """
    if (table is None) == (query is None):
        raise ValueError("give exactly one of table or query")
    opts: dict[str, str] = {"url": url, "fetchsize": str(fetch_size)}
    if partition_column is not None:
        if lower_bound is None or upper_bound is None or not num_partitions:
            raise ValueError("partitioned JDBC reads need lower_bound, upper_bound and num_partitions")
        opts["dbtable"] = table if table is not None else f"({query}) q"
        opts.update(partitionColumn=partition_column, lowerBound=str(lower_bound),
                    upperBound=str(upper_bound), numPartitions=str(num_partitions))
    elif table is not None:
        opts["dbtable"] = table
    else:
        opts["query"] = query
    opts.update({k: str(v) for k, v in extra.items()})
    return opts


def read_jdbc(spark: SparkSession, url: str, **kwargs) -> DataFrame:
    """Database scan (S1): a parallel JDBC read built from ``jdbc_options``."""
    return spark.read.format("jdbc").options(**jdbc_options(url, **kwargs)).load()


def _sql_value(v) -> str:
    if isinstance(v, dt.datetime):
        return f"TIMESTAMP '{v:%Y-%m-%d %H:%M:%S.%f}'"
    return f"DATE '{v}'" if isinstance(v, dt.date) else repr(v) if isinstance(v, float) else str(v)


def _cuts(df: DataFrame, column: str, parts: int) -> list:
    """The values at 1/parts, 2/parts, ... of the rows, with repetitions."""
    found = df.agg(F.percentile_approx(column, [k / parts for k in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else []
    return list(found or [])


def key_ranges(df: DataFrame, column: str, parts: int, hot_by: str | None = None) -> list[str]:
    """Predicates that cut the rows of ``df`` into about ``parts`` equally deep ranges of ``column``.

    Every row satisfies exactly one of them, rows without a key the last.  The bounds are approximate percentiles of the
    data, so gaps and skew of the keys do not matter.  A value that fills a range and more has a range of its own;
    with ``hot_by`` that one is cut by equally deep ranges of the second column.  Numbers, dates and times; ``df`` needs
    the key columns only (a narrow scan of the table, or of a copy of its keys).
    """
    cuts = _cuts(df, column, parts)
    times = {v: cuts.count(v) for v in cuts}
    out, below = [], ""
    for v in sorted(times):
        at = _sql_value(v)
        if times[v] == 1:
            out.append(f"{below}{column} < {at}")
            below = f"{column} >= {at} AND "
            continue
        out.append(f"{below}{column} < {at}")
        own = key_ranges(df.where(F.col(column) == F.lit(v)), hot_by, times[v]) if hot_by else [""]
        out += [f"{column} = {at}" + (f" AND {p}" if p else "") for p in own]
        below = f"{column} > {at} AND "
    last = below.removesuffix(" AND ") or f"{column} IS NOT NULL"
    return [*out, last, f"{column} IS NULL"]


def read_jdbc_ranges(spark: SparkSession, url: str, table: str, predicates: list[str], fetch_size: int = 10_000, **extra: str) -> DataFrame:
    """Database scan with one task for each predicate of :func:`key_ranges`."""
    return spark.read.jdbc(url, table, predicates=predicates, properties={"fetchsize": str(fetch_size), **{k: str(v) for k, v in extra.items()}})


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str,
             header: bool = True, mode: str = "FAILFAST") -> DataFrame:
    """CSV with header and explicit schema (S3); NaN becomes null.

    A cell that does not fit its type stops the read (``mode`` as in Spark's CSV source).
    """
    df = (spark.read.schema(schema).option("header", header)
          .option("mode", mode).csv(path))
    return nan_to_null(df)


def bad_numbers(df: DataFrame, columns: list[str] | tuple[str, ...]) -> dict[str, int]:
    """How many non-empty cells of each text column are no numbers (one aggregate; only columns that have some)."""
    if not columns:
        return {}
    row = df.agg(*[F.count_if((F.trim(c) != "") & F.expr(f"try_cast(trim(`{c}`) AS double)").isNull()).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns if row[c]}


def read_wide_csv(spark: SparkSession, path: str, numeric: list[str] | tuple[str, ...] = (), bad: str = "error") -> DataFrame:
    """A wide customer table exported as CSV (the application's file input).

    The names come from the CSV reader's own header line (quotes and commas in
    names included); columns named in ``numeric`` become doubles, all others stay
    text.  An unnamed first column (a row index written with the file) is
    dropped.  Cells of numeric columns that are no numbers are counted: with
    ``bad="error"`` they stop the read and are reported, with ``bad="null"`` they
    become null.  Empty cells are null.
    """
    if bad not in ("error", "null"):
        raise ValueError('bad must be "error" or "null"')
    df = spark.read.option("header", True).csv(path)
    if not df.columns:
        raise ValueError(f"{path} is empty")
    if df.columns[0] == "_c0":
        df = df.drop("_c0")
    chosen = [c for c in df.columns if c in set(numeric)]
    if bad == "error" and (found := bad_numbers(df, chosen)):
        raise ValueError(f"{path}: cells that are no numbers: {found}")
    number = {c: F.expr(f"try_cast(nullif(trim(`{c}`), '') AS double)") for c in chosen}
    return nan_to_null(df.withColumns(number) if number else df)
