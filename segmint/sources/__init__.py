"""Readers and writers: Parquet, JDBC, CSV, month snapshots and store, catalogue, sinks."""

from segmint.sources.catalog import load_catalog, missing_columns, unknown_selections
from segmint.sources.readers import jdbc_options, key_ranges, read_csv, read_jdbc, read_jdbc_ranges, read_table, read_wide_csv
from segmint.sources.sinks import write_bucketed, write_client_table, write_profile
from segmint.sources.snapshots import (month_snapshots, read_snapshot, snapshot_exists,
                                       snapshot_or_build, union_months, write_snapshot)
from segmint.sources.store import MonthStore

__all__ = [
    "load_catalog", "missing_columns", "unknown_selections", "jdbc_options", "key_ranges", "read_csv",
    "read_jdbc", "read_jdbc_ranges", "read_table", "MonthStore", "read_wide_csv", "write_bucketed", "write_client_table", "write_profile", "month_snapshots",
    "read_snapshot", "snapshot_exists", "snapshot_or_build", "union_months", "write_snapshot",
]
