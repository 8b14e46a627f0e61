"""Column preparation: imputation, caps, flags, casts.

All helpers return Columns or DataFrames built from built-in functions, so they
stay inside whole-stage codegen.  None of them collects data, except
``parse_all_valid`` which needs one aggregate to decide.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, _NUMERIC)


def nan_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Floating NaN becomes null, the one missing marker used downstream."""
    cols = set(columns) if columns is not None else None
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)) and (cols is None or f.name in cols):
            out.append(F.when(F.isnan(f.name), F.lit(None).cast(f.dataType))
                       .otherwise(F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def impute_defaults(df: DataFrame, text: Mapping[str, str] | None = None,
                    numbers: Mapping[str, float] | None = None) -> DataFrame:
    """Fill text columns with a label and numeric columns with a number.

    ``fillna`` also replaces NaN in floating columns.
    """
    fills = {}
    fills.update(text or {})
    fills.update(numbers or {})
    present = {k: v for k, v in fills.items() if k in df.columns}
    return df.fillna(present) if present else df


def fill_selected(df: DataFrame, columns: Iterable[str], value: float = 0,
                  fill_text: str | None = "0") -> DataFrame:
    """Fill every selected column: numbers with ``value``, text with ``fill_text``.

    A pandas-style ``fillna(0)`` writes the zero into text columns as well; Spark's
    ``fillna(0)`` skips them, so text gets its own fill (``None`` leaves it null).
    """
    columns = list(columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    num = [c for c in columns if is_numeric(types[c])]
    txt = [c for c in columns if isinstance(types[c], T.StringType)]
    if num:
        df = df.fillna(value, subset=num)
    if txt and fill_text is not None:
        df = df.fillna(fill_text, subset=txt)
    return df


def select_variables(df: DataFrame, id_col: str, model: Iterable[str],
                     reporting: Iterable[str] = ()) -> DataFrame:
    """``id + model + reporting`` columns, each once.

    A reporting column that is also a model column is kept once, in the model
    block; unknown names raise before any data is read.
    """
    model = list(dict.fromkeys(model))
    reporting = [c for c in dict.fromkeys(reporting) if c not in model and c != id_col]
    missing = [c for c in [id_col, *model, *reporting] if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns: {missing}")
    return df.select(id_col, *model, *reporting)


def cap_value(col: Column | str, cap: float = 30.0, fill: float = 0.0) -> Column:
    """Null becomes ``fill``, then values are capped at ``cap`` (X11)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.least(F.coalesce(c.cast("double"), F.lit(float(fill))), F.lit(float(cap)))


def flag_to_int(col: Column | str, true_value: str = "1") -> Column:
    """Text flag to 1/0: exactly ``true_value`` is 1, anything else (null too) is 0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.cast("string") == F.lit(true_value), F.lit(1)).otherwise(F.lit(0))


def parse_when_all_valid(df: DataFrame, column: str, fmt: str | None = None) -> DataFrame:
    """Convert a text column to timestamp only if every non-null value parses."""
    return parse_all_valid(df, [column], fmt)


def parse_all_valid(df: DataFrame, columns: Iterable[str], fmt: str | None = None) -> DataFrame:
    """Convert those of the text columns to timestamps whose every non-null value parses.

    One aggregate holds a state for every column, the number of values that fail; a column where
    any fails stays as it is, as a pandas ``to_datetime`` that raises would leave it.
    """
    texts = [c for c in dict.fromkeys(columns) if isinstance(df.schema[c].dataType, T.StringType)]
    if not texts:
        return df
    parsed = {c: F.try_to_timestamp(F.col(c), F.lit(fmt)) if fmt else F.try_to_timestamp(F.col(c)) for c in texts}
    bad = df.agg(*[F.count_if(F.col(c).isNotNull() & parsed[c].isNull()).alias(f"bad{i}") for i, c in enumerate(texts)]).first()
    sound = {c: parsed[c] for i, c in enumerate(texts) if not bad[f"bad{i}"]}
    return df.withColumns(sound) if sound else df


def strip_timezone(col: Column | str) -> Column:
    """Keep the wall-clock time and drop the zone: timestamp -> timestamp_ntz."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast(T.TimestampNTZType())


def dedup_first(df: DataFrame, key: str | list[str], order_by: list[str]) -> DataFrame:
    """Keep one row per key: the one that sorts first on ``order_by``.

    ``min(struct(order..., rest...))`` is an ordinary aggregate, so Spark
    combines map-side before the shuffle; a hot key that holds a third of all
    rows still arrives at its reducer as one partial row per map task, never
    as one sorted window partition.  The full struct makes ties deterministic.

    A struct buffer is variable-length, so Spark runs this as a sort-based
    aggregate (partial on the map side, final on the reduce side).  The
    hash-based alternative - ``min`` of the ordering columns, then a join back
    to fetch the row - would shuffle every input row and put a hot key's rows
    in one join partition; sorting partial aggregates is the cheaper price.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    packed = F.struct(*[F.col(c) for c in order_by + rest])
    return (df.groupBy(*keys).agg(F.min(packed).alias("__first"))
              .select(*keys, *[F.col("__first")[c].alias(c) for c in df.columns if c not in keys]))
