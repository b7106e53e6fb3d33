"""Outcome summaries by start year, drug and indication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careline.functions import labels as L
from careline.functions.rounding import round_to
from careline.functions.semantics import strict
from careline.functions.text import count_label, percent_text

COUNTS = {"n_success": L.SUCCESS, "n_failure": L.FAILURE, "n_no_change": L.NO_CHANGE}
# Stacking order of the results in reports.
RESULT_ORDER = ("n_no_change", "n_failure", "n_success")


def completed_years(frame: DataFrame, as_of_year: int, column: str = "start_year") -> DataFrame:
    """Rows of the four completed years before `as_of_year`."""
    return frame.filter(F.col(column).between(as_of_year - 4, as_of_year - 1))


def current_years(frame: DataFrame, as_of_year: int, column: str = "start_year") -> DataFrame:
    """Rows of `as_of_year` and the three years before it."""
    return frame.filter(F.col(column).between(as_of_year - 3, as_of_year))


def year_range(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(F.min("start_year").alias("first_year"),
                        F.max("start_year").alias("last_year"))


def _shares(total: Column, times_first: bool, rounding: str) -> dict[str, Column]:
    hundred = F.lit(100.0)
    shares = {}
    for name in COUNTS:
        n = F.col(name).cast("double")
        share = F.try_divide(n * hundred, total) if times_first \
            else F.try_divide(n, total) * hundred
        shares[f"pct_{name[2:]}"] = round_to(share, 1, rounding)
    return shares


def _total() -> Column:
    return F.col("n_success") + F.col("n_failure") + F.col("n_no_change")


def outcome_summary(outcomes: DataFrame, rounding: str = "half_up") -> DataFrame:
    """Counts and shares of results of followed-up processes per group.

    One process with an unknown result makes the counts of its group unknown.
    """
    keys = [c for c in ("start_year", "drug_name", "indication_code", "indication_name")
            if c in outcomes.columns]
    result = F.col("result")
    counts = [strict(F.count_if(result == value), result).alias(name)
              for name, value in COUNTS.items()]
    # a missing duration among the successes makes their mean missing
    days = F.when(result == L.SUCCESS, F.col("days_to_minimum"))
    mean_days = F.when(F.count(days) == F.count_if(result == L.SUCCESS), F.avg(days))
    return (outcomes.filter(F.col("n") > 1)
            .groupBy(*keys)
            .agg(*counts, round_to(mean_days, 1, rounding).alias("mean_days_to_minimum"))
            .withColumns(_shares(_total(), False, rounding)))


def outcome_report(summary: DataFrame, as_of_year: int) -> DataFrame:
    """Printed form of the summary: completed years, shares as text."""
    shown = {f"pct_{n[2:]}": percent_text(F.col(f"pct_{n[2:]}")) for n in COUNTS}
    return completed_years(summary, as_of_year).withColumns(shown).drop("indication_name")


def outcome_rollup(summary: DataFrame, as_of_year: int, rounding: str = "half_up") -> DataFrame:
    """Summary over all indications, completed years only."""
    return (completed_years(summary, as_of_year)
            .groupBy("start_year", "drug_name")
            .agg(*[strict(F.sum(n), n).alias(n) for n in COUNTS])
            .withColumns(_shares(_total(), True, rounding)))


def outcome_long(rollup: DataFrame) -> DataFrame:
    """One row per result type with the labels shown on charts."""
    entries = F.array(*[F.struct(F.lit(name).alias("result_type"),
                                 F.lit(i).cast("int").alias("result_order"),
                                 F.col(name).alias("n"))
                        for i, name in enumerate(RESULT_ORDER, start=1)])
    n = F.col("n")
    return (rollup.select("start_year", "drug_name", F.explode(entries).alias("__e"))
            .select("start_year", "drug_name", "__e.*")
            .withColumn("label", F.when(n > 3, n))
            .withColumn("label_text", count_label(n, above=0)))
