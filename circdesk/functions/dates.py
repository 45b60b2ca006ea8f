"""Date arithmetic on ``timestamp_ntz`` columns.

Every job takes one explicit ``as_of`` moment, so a rerun after a lost executor (or next week)
gives the same rows; ``current_timestamp()`` is never used.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(as_of: datetime | str) -> Column:
    """A literal ``timestamp_ntz``, independent of the session time zone."""
    text = as_of if isinstance(as_of, str) else as_of.isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


def days_between(start: Column, end: Column) -> Column:
    """Midnights crossed from ``start`` to ``end`` (negative when ``end`` is earlier)."""
    return F.datediff(end, start)


def plus_days(start: Column, days: Column | int) -> Column:
    """``start`` moved by whole days with its time of day kept; null days give null."""
    count = F.lit(days) if isinstance(days, int) else days
    return start + F.make_dt_interval(count)


def period_start(moment_col: Column, unit: str) -> Column:
    """First date of the day, month, quarter or year that holds the moment."""
    day = moment_col.cast("date")
    if unit == "day":
        return day
    if unit not in ("month", "quarter", "year"):
        raise ValueError(f"unknown period unit: {unit}")
    return F.trunc(day, unit)
