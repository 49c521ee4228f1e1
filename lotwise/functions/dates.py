"""Calendar rules: sampling buckets and the date a quote is expected for."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# From this hour on, the quote of the same day is expected.
PUBLISHED_FROM_HOUR = 22
WEEKS = "weeks"
MONTHS = "months"


def expected_quote_date(moment: Column) -> Column:
    """Date whose quote should be known at ``moment``; weekends fall back to Friday."""
    day = F.to_date(moment)
    day = F.when(F.hour(moment) < PUBLISHED_FROM_HOUR, F.date_sub(day, 1)).otherwise(day)
    return F.date_sub(day, F.greatest(F.weekday(day) - 4, F.lit(0)))


def bucket_end(start: Column, number: Column, period: str) -> Column:
    """Closing date of sampling bucket ``number``; bucket 0 closes at ``start``."""
    number = number.cast("int")
    if period == WEEKS:
        return F.date_add(start, number * 7)
    return F.add_months(start, number)


def bucket_number(date: Column, start: Column, period: str) -> Column:
    """Number of the right-closed bucket that holds ``date``, by arithmetic."""
    if period == WEEKS:
        return F.ceil(F.datediff(date, start) / 7).cast("int")
    if period != MONTHS:
        raise ValueError(f"unknown period: {period}")
    months = (F.year(date) - F.year(start)) * 12 + F.month(date) - F.month(start)
    return (months + F.when(date > F.add_months(start, months), 1).otherwise(0)).cast("int")


def last_bucket(start: dt.date, end: dt.date, period: str) -> int:
    """Number of the last bucket: the first one that closes after ``end``."""
    if end < start:
        return 0
    if period == WEEKS:
        return (end - start).days // 7 + 1
    if period != MONTHS:
        raise ValueError(f"unknown period: {period}")
    months = (end.year - start.year) * 12 + end.month - start.month
    return months + 1 if _add_months(start, months) <= end else months


def _add_months(date: dt.date, months: int) -> dt.date:
    first = date.year * 12 + date.month - 1 + months
    year, month = divmod(first, 12)
    following = dt.date(year + (month == 11), (month + 1) % 12 + 1, 1)
    return dt.date(year, month + 1, min(date.day, (following - dt.timedelta(days=1)).day))
