"""Text formatting of numbers and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_text(x: Column) -> Column:
    """Number as text without a trailing `.0`; a missing number prints as NA."""
    return F.coalesce(F.regexp_replace(x.cast("string"), r"\.0$", ""), F.lit("NA"))


def percent_text(x: Column) -> Column:
    return F.concat(number_text(x), F.lit("%"))


def count_label(n: Column, above: int) -> Column:
    """`n=<count>` when the count exceeds `above`, else nothing."""
    return F.when(n > above, F.concat(F.lit("n="), n.cast("string")))


def strip_zeros(identifier: Column) -> Column:
    return F.regexp_replace(identifier, "^0+", "")


def drop_last_character(x: Column) -> Column:
    return F.substring(x, F.lit(1), F.length(x) - 1)


def or_na(x: Column) -> Column:
    """Text in which a missing value is spelled NA."""
    return F.coalesce(x.cast("string"), F.lit("NA"))


def integer_of(x: Column) -> Column:
    """Whole number of a text, cutting decimals; NULL if it is not a number."""
    return x.cast("string").try_cast("double").try_cast("int")
