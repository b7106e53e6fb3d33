"""Elapsed time between two timestamps.

Days and weeks are elapsed time; months follow the calendar. Session time zone
is UTC (`session.configure`), so timestamps without time zone convert unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole elapsed days, rounded down (a midnight in between is not a day)."""
    return F.floor((_micros(end) - _micros(start)) / F.lit(float(MICROS_PER_DAY)))


def elapsed_weeks(start: Column, end: Column) -> Column:
    return F.floor((_micros(end) - _micros(start)) / F.lit(7.0 * MICROS_PER_DAY))


def day_number(ts: Column) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(F.to_date(ts))


def _plus_months(ts: Column, months: Column) -> Column:
    return ts + F.make_ym_interval(F.lit(0), months.cast("int"))


def _ordered(start: Column, end: Column) -> tuple[Column, Column, Column]:
    """Earlier and later timestamp, and the largest k with earlier + k months
    (clamped to the month end) <= later."""
    low, high = F.least(start, end), F.greatest(start, end)
    k = F.timestamp_diff("MONTH", low, high).cast("int")
    return low, high, k + (_plus_months(low, k + 1) <= high).cast("int")


def months_between(start: Column, end: Column) -> Column:
    """Calendar months with fraction; negative when `end` precedes `start`."""
    low, high, k = _ordered(start, end)
    at_k = _micros(_plus_months(low, k))
    months = k + (_micros(high) - at_k) / (_micros(_plus_months(low, k + 1)) - at_k)
    sign = F.when(end < start, -1.0).when(end >= start, 1.0)
    return sign * months


def whole_months(start: Column, end: Column) -> Column:
    """Calendar months rounded down."""
    low, high, k = _ordered(start, end)
    return (F.when(end < start, -k - (_plus_months(low, k) < high).cast("int"))
             .when(end >= start, k))
