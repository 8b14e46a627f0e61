"""Month-end arithmetic.

Snapshots are keyed by the last day of a month.  "n months back" means the
month end of ``as_of`` shifted by ``-n`` months.  The driver-side variants
return Python dates so that bounds enter the plan as literals and reach the
Parquet scan as pushed filters; the Column variants work per row.
"""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_date(value) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    if value is None:
        return dt.date.today()
    return dt.date.fromisoformat(str(value)[:10])


def month_end_of(as_of=None, months_back: int = 0) -> dt.date:
    """Last day of the month ``months_back`` months before ``as_of`` (driver side)."""
    d = _as_date(as_of)
    idx = d.year * 12 + (d.month - 1) - months_back
    year, month = divmod(idx, 12)
    month += 1
    return dt.date(year, month, calendar.monthrange(year, month)[1])


def month_start_of(as_of=None, months_back: int = 0) -> dt.date:
    """First day of the month ``months_back`` months before ``as_of`` (driver side)."""
    return month_end_of(as_of, months_back).replace(day=1)


def month_ends(as_of=None, months=(1, 2, 3)) -> list[dt.date]:
    """Month ends for each offset in ``months``."""
    return [month_end_of(as_of, m) for m in months]


def month_end(col: Column | str, months_back: int = 0) -> Column:
    """Per-row month end ``months_back`` months before ``col``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.last_day(F.add_months(F.to_date(c), -months_back))


def snapshot_label(col: Column | str) -> Column:
    """``YYYY_MM_DD`` label used to name monthly snapshot files."""
    c = F.col(col) if isinstance(col, str) else col
    return F.date_format(c, "yyyy_MM_dd")


def snapshot_label_of(as_of=None, months_back: int = 1) -> str:
    """Driver-side ``YYYY_MM_DD`` label of the previous month end."""
    return month_end_of(as_of, months_back).strftime("%Y_%m_%d")


def months_index(col: Column | str) -> Column:
    """Whole-month ordinal ``year*12 + month`` (for exact month differences)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.year(c) * 12 + F.month(c)
