"""Date predicates written so that they reach the file scan."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(value: date) -> Column:
    return F.lit(value).cast("date")


def month_window(year: int, first_month: int, last_month: int | None = None) -> tuple[date, date]:
    """Half-open day range covering whole calendar months of one year."""
    last_month = last_month or first_month
    end = date(year + 1, 1, 1) if last_month == 12 else date(year, last_month + 1, 1)
    return date(year, first_month, 1), end


def in_window(col: Column, start: date, end: date) -> Column:
    """`start <= col < end`. Unlike year()/month() tests this is pushed down and skips row groups."""
    return (col >= day(start)) & (col < day(end))


def since(col: Column, base: date, days: int) -> Column:
    """On or after the day `days` before `base` (inclusive, no upper bound)."""
    return col >= F.date_sub(day(base), days)


def older_than(col: Column, as_of: Column | date, days: Column | int) -> Column:
    """More than `days` days before `as_of`; dates after `as_of` are never old."""
    ref = day(as_of) if isinstance(as_of, date) else as_of
    return F.datediff(ref, col) > days
