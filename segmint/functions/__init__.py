"""Column-level helpers: month ends, imputation, caps, flags, casts."""

from segmint.functions.dates import (month_end, month_end_of, month_ends, month_start_of,
                                     months_index, snapshot_label, snapshot_label_of)
from segmint.functions.prep import (cap_value, dedup_first, fill_selected,
                                    flag_to_int, impute_defaults, nan_to_null,
                                    parse_all_valid, parse_when_all_valid, select_variables, strip_timezone)

__all__ = [
    "month_end", "month_end_of", "month_ends", "month_start_of", "months_index",
    "snapshot_label", "snapshot_label_of", "cap_value", "dedup_first", "fill_selected", "flag_to_int", "impute_defaults", "nan_to_null",
    "parse_all_valid", "parse_when_all_valid", "select_variables", "strip_timezone",
]
