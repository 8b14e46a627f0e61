"""Variable catalogue.

The catalogue is a JSON object with two string lists, ``model_variables`` and
``reporting_variables``: names, so a few dozen short texts.  A file of the driver's
machine (such as the package's own) is read there; an address of a shared store
by Spark.  Either way it becomes a ``(variable, role)`` frame for joins.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CATALOG = os.path.join(os.path.dirname(__file__), "variables.json")


ROLES = {"model_variables": "model", "reporting_variables": "reporting"}


def load_catalog(spark: SparkSession, path: str = DEFAULT_CATALOG) -> DataFrame:
    if "://" in path:
        raw = spark.read.option("multiLine", True).json(path)
        return raw.select(F.inline(F.concat(*[F.transform(key, lambda v, role=role: F.struct(v.alias("variable"), F.lit(role).alias("role")))
                                              for key, role in ROLES.items()])))
    with open(path, encoding="utf-8") as f:
        lists = json.load(f)
    return spark.createDataFrame([(v, role) for key, role in ROLES.items() for v in lists[key]], "variable string, role string")


def unknown_selections(catalog: DataFrame, selected: list[str], role: str) -> DataFrame:
    """Selected names that the catalogue does not list under ``role`` (anti join)."""
    spark = catalog.sparkSession
    sel = spark.createDataFrame([(s,) for s in selected], "variable string")
    allowed = catalog.where(F.col("role") == role).select("variable")
    return sel.join(allowed, "variable", "left_anti")


def missing_columns(catalog: DataFrame, df: DataFrame) -> DataFrame:
    """Catalogued variables that ``df`` does not have (names only; no data is read)."""
    spark = catalog.sparkSession
    cols = spark.createDataFrame([(c,) for c in df.columns], "variable string")
    return catalog.join(cols, "variable", "left_anti")
