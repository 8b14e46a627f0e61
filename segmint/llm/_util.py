"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmint.session import cut_lineage

#: The white space of the word rules: [\x20\x09-\x0D].  ``bytes.split()`` splits at exactly these.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_BYTES = BLANKS.encode()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query or stage (session first) with Arrow batches of at most 1,000 rows, where the session has not chosen
    another number than Spark's 10,000: ten thousand whole texts are too much for a batch."""
    @functools.wraps(f)
    def run(spark: SparkSession, *args) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if spark.conf.get(key) == "10000":
            spark.conf.set(key, "1000")
        return f(spark, *args)
    return run


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` in the shared checkpoint folder and go on from the written table."""
    return cut_lineage(df)


def map_arrow(df: DataFrame, rows: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """``mapInArrow`` where ``rows`` turns one batch (column name -> list) into one batch of ``schema``.

    Strings named in ``text`` columns arrive as the frame holds them; cast a
    column to binary first to get UTF-8 bytes.
    """
    out = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                yield pa.RecordBatch.from_pydict(rows({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}), schema=out)

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def id_crc_mod(col: str | Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n`` (null ids: as the empty text, so 0)."""
    own = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(own.cast("string"), F.lit("")).cast("binary")) % n


def text_bytes(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary").alias("text")
