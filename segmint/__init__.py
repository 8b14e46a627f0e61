"""segmint — customer segmentation on Spark.

Builds one wide feature row per customer from monthly transaction snapshots and
event facts, filters the population with composable specs, reports pairwise
correlation, standardises model variables, runs k-means (elbow sweep and final
fit) and profiles every cluster.  Everything is DataFrame / Spark SQL / MLlib;
no Python UDFs.

Sub-packages
------------
``sources``    readers and writers (parquet, JDBC, CSV, month snapshots, catalogue)
``functions``  column-level helpers (month ends, imputation, flags, casts)
``operators``  relational building blocks (filters, pivots, channel aggregates,
               statistics, modelling)
``plans``      composed plans: the customer-wide view, the view layer in SQL,
               the segmentation flow and the registered queries
"""

from segmint.session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]
