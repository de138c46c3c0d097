"""Helpers to evaluate many policies in one pass."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_starts(start: date, end: date) -> list[date]:
    """First days of the calendar months a half-open window touches."""
    out, cur = [], date(start.year, start.month, 1)
    while cur < end:
        out.append(cur)
        cur = date(cur.year + cur.month // 12, cur.month % 12 + 1, 1)
    return out


def chosen(columns: list[str], index: str) -> Column:
    """The column whose position is given by another column."""
    return F.element_at(F.array(*columns), F.col(index) + 1)


def with_close_month(opps: DataFrame, windows: list[tuple[date, date]] | None = None) -> DataFrame:
    """Opportunities with the month they close in. Where they are saved by month, that is the column
    of their partitions: a join on it reads the asked months only, and with `windows` known
    beforehand, only their months are listed at all."""
    if "close_month" not in opps.columns:
        return opps.withColumn("close_month", F.trunc("expected_close_date", "MM"))
    if windows is None:
        return opps
    months = sorted({month for start, end in windows for month in month_starts(start, end)})
    return opps.where(F.col("close_month").isin(months))
