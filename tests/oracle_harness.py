"""Run a registered query in Spark and its SQL in DuckDB; compare the results.

Columns are sorted by name, rows are sorted, then every cell is compared
exactly (floats too, after normalising -0.0 and NaN/None).  ``close`` counts
cells that differ only beyond 1e-9 relative, which flags summation-order noise.
"""

from __future__ import annotations

import math
import os

import duckdb
import numpy as np
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, (float, np.floating)):
        if math.isnan(v):
            return None
        return float(v) + 0.0
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if hasattr(v, "tolist"):
        return tuple(v.tolist())
    if isinstance(v, list):
        return tuple(v)
    return v


def _rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark_df, duck_df: pd.DataFrame) -> dict:
    s = spark_df.toPandas()
    res = {"spark_rows": len(s), "oracle_rows": len(duck_df),
           "columns_match": sorted(s.columns) == sorted(duck_df.columns)}
    if not res["columns_match"]:
        res["spark_columns"] = sorted(s.columns)
        res["oracle_columns"] = sorted(duck_df.columns)
        res["match"] = False
        return res
    a, b = _rows(s), _rows(duck_df)
    exact = close = 0
    first_diff = None
    for ra, rb in zip(a, b):
        if ra == rb:
            exact += 1
            continue
        ok = True
        for x, y in zip(ra, rb):
            if x == y:
                continue
            if isinstance(x, float) and isinstance(y, (float, int)) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12):
                continue
            ok = False
        if ok:
            close += 1
        elif first_diff is None:
            first_diff = (ra, rb)
    res.update(exact=exact, close=close, match=(len(a) == len(b) and exact == len(a)))
    if first_diff is not None:
        res["first_diff"] = first_diff
    return res
