"""Rounding used in reports and before the coverage thresholds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(x: Column, digits: int = 0, mode: str = "half_up") -> Column:
    """Round a double; halves go away from zero, or to even with `half_even`."""
    if mode == "half_even":
        return F.bround(x, digits)
    if mode != "half_up":
        raise ValueError(f"unknown rounding mode {mode!r}")
    scale = F.lit(float(10 ** digits))
    scaled = F.floor(F.abs(x) * scale + F.lit(0.5)) / scale
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.signum(x) * scaled)


def round_up_to(x: Column, multiple: Column | float) -> Column:
    """Smallest multiple of `multiple` that is >= x; used for axis limits."""
    m = multiple if isinstance(multiple, Column) else F.lit(multiple)
    return F.ceil(x / m) * m


def tenths(x: Column) -> Column:
    """A value with one decimal as an integer number of tenths, for exact sums."""
    return F.round(x * 10).cast("bigint")


def mean_of_tenths(total: Column, count: Column) -> Column:
    """Mean of one-decimal values from their exact sum in tenths, to one decimal."""
    return F.when(count > 0, F.floor(F.abs(total) / count + F.lit(0.5))
                  * F.signum(total) / F.lit(10.0))
