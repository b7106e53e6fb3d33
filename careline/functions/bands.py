"""Banding of scores, coverage and ages, with their display order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from careline.functions import labels as L


def activity_band(score: Column, cap: float | None = L.SCORE_LIMIT) -> Column:
    """Disease-activity band; above `cap` there is none (no upper cut if None)."""
    high = F.lit(True) if cap is None else score <= cap
    return (F.when(score < L.SCORE_REMISSION, L.REMISSION)
             .when(score <= L.SCORE_LOW, L.ACTIVITY_LOW)
             .when(score <= L.SCORE_MODERATE, L.ACTIVITY_MODERATE)
             .when((score > L.SCORE_MODERATE) & high, L.ACTIVITY_HIGH))


def coverage_class(coverage: Column, days: Column) -> Column:
    low, mid, good, best = L.COVERAGE_LEVELS
    return (F.when(days == 1, L.COVERAGE_SINGLE)
             .when(coverage >= 0.9, best)
             .when(coverage >= 0.8, good)
             .when(coverage >= 0.5, mid)
             .when(coverage < 0.5, low))


def age_band(age: Column) -> Column:
    """Band of an age in whole years; a missing age has its own band."""
    bands = L.AGE_LEVELS
    return (F.when(age < 20, bands[0]).when(age <= 40, bands[1])
             .when(age <= 50, bands[2]).when(age <= 60, bands[3])
             .when(age <= 70, bands[4]).when(age <= 80, bands[5])
             .when(age > 80, bands[6]).otherwise(bands[7]))


def level_order(value: Column, levels) -> Column:
    """1-based position of a category in its display order."""
    order = F.when(value == levels[0], 1)
    for i, level in enumerate(levels[1:], start=2):
        order = order.when(value == level, i)
    return order.cast("int")
