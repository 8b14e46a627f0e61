"""The end-to-end segmentation flow.

customer-wide row -> segment filter -> select + fill -> standardise ->
k-means -> client table + cluster profile.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from segmint.operators import filters as flt
from segmint.operators import model as mdl
from segmint.operators import stats as st
from segmint.plans import wide


@dataclass
class SegmentationResult:
    clients: DataFrame           # id, model columns, Cluster, reporting columns
    profile_long: DataFrame      # row_order, row_label, Cluster, value
    profile_wide: DataFrame      # row_order, row_label, "0" ... "k-1"
    fit: mdl.KMeansFit


def run_segmentation(spark: SparkSession, root: str, model_cols, reporting_cols, k: int,
                     ranges=None, members=None, seeds=(42,), active_only: bool = False
                     ) -> SegmentationResult:
    src = wide.customer_wide(spark, root, active_only=active_only)
    chosen = flt.filter_segment(src, ranges, members)
    clients, fit = mdl.segment(chosen, "PERS_ID", model_cols, reporting_cols, k, seeds)   # written table
    long = st.profile_long(clients, model_cols, "Cluster")
    return SegmentationResult(clients, long, st.profile_wide(long, k), fit)
