"""Proportion of days covered and its summaries.

Dispensings are reduced to one row per patient, specialty and posology, those to
one per patient and specialty; both are joined to the treatments, the distinct
combinations of patient, drug and prescription. Everything is combined on the map
side before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careline.functions import labels as L
from careline.functions.bands import coverage_class, level_order
from careline.functions.rounding import mean_of_tenths, round_to, round_up_to, tenths
from careline.functions.semantics import join_on
from careline.functions.text import count_label, percent_text
from careline.functions.timeparts import elapsed_days

SPECIALTY = ["nhc", "national_code"]
POSOLOGY = [*SPECIALTY, "posology_days"]
# Column suffix of every coverage class.
CLASS_NAMES = dict(zip(L.COVERAGE_LEVELS, ("below_05", "05_to_08", "08_to_09", "from_09")))


def _ratio(units: Column, posology: Column, days: Column, rounding: str) -> Column:
    """units / (1 / posology) / days, to one decimal; NULL unless finite.

    A posology of zero makes the ratio zero, as its reciprocal is infinite.
    """
    per_day = F.when(posology == 0, F.lit(0.0)).otherwise(
        F.try_divide(units, F.try_divide(F.lit(1.0), posology)))
    return round_to(F.try_divide(per_day, days.cast("double")), 1, rounding)


def treatment_sums(valid: DataFrame) -> DataFrame:
    """One row per treatment: dispensing rows, quantities and their sum, first and last dispensing.

    All that coverage needs of the valid dispensings, combined where the join makes them.
    """
    ts, qty = F.col("dispensed_at"), F.col("qty")
    return valid.groupBy(*[c for c in valid.columns if c not in ("dispensed_at", "qty")]).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(qty).alias("n_qty"), F.sum(qty).alias("sum_qty"),
        F.min(ts).alias("first_at"), F.max(ts).alias("last_at"))


def coverage_of(sums: DataFrame, weight: str = "row", rounding: str = "half_up") -> DataFrame:
    """`coverage_ratio` from the rows of `treatment_sums`."""
    if weight not in ("row", "posology"):
        raise ValueError(f"unknown weight {weight!r}")
    posologies = (sums.groupBy(*POSOLOGY)
                  .agg(F.sum("n_rows").alias("n_rows"),
                       F.when(F.sum("n_qty") == F.sum("n_rows"), F.sum("sum_qty")).alias("units"),
                       elapsed_days(F.min("first_at"), F.max("last_at")).alias("days"))
                  .withColumn("coverage_posology",
                              _ratio(F.col("units"), F.col("posology_days"), F.col("days"),
                                     rounding))
                  .filter(F.col("coverage_posology").isNotNull()))
    rows = F.col("n_rows") if weight == "row" else F.lit(1)
    specialties = (posologies.groupBy(*SPECIALTY)
                   .agg(mean_of_tenths(F.sum(tenths(F.col("coverage_posology")) * rows),
                                       F.sum(rows)).alias("coverage")))
    rated = join_on(posologies.drop("n_rows"), specialties, SPECIALTY)
    return join_on(sums.drop("n_rows", "n_qty", "sum_qty", "first_at", "last_at"), rated, POSOLOGY)


def coverage_within(sums: DataFrame, weight: str = "row", rounding: str = "half_up") -> DataFrame:
    """`coverage_of` where no patient has many rows: windows inside a patient, so rows dealt out by
    patient are not exchanged again."""
    if weight not in ("row", "posology"):
        raise ValueError(f"unknown weight {weight!r}")
    posology, specialty = Window.partitionBy(*POSOLOGY), Window.partitionBy(*SPECIALTY)
    kept = [c for c in sums.columns if c not in ("n_rows", "n_qty", "sum_qty", "first_at", "last_at")]
    n, ratio = F.sum("n_rows").over(posology), F.col("coverage_posology")
    rated = (sums.select(
        *kept, n.alias("__n"),
        F.when(F.sum("n_qty").over(posology) == n, F.sum("sum_qty").over(posology)).alias("units"),
        elapsed_days(F.min("first_at").over(posology), F.max("last_at").over(posology)).alias("days"),
        (F.row_number().over(posology.orderBy("valid_from")) == 1).alias("__one"))
        .withColumn("coverage_posology", _ratio(F.col("units"), F.col("posology_days"),
                                                F.col("days"), rounding))
        .filter(ratio.isNotNull()))
    rows = F.when(F.col("__one"), F.col("__n") if weight == "row" else F.lit(1))
    mean = mean_of_tenths(F.sum(tenths(ratio) * rows).over(specialty), F.sum(rows).over(specialty))
    return rated.select(*kept, "units", "days", "coverage_posology", mean.alias("coverage"))


def coverage_ratio(valid: DataFrame, weight: str = "row", rounding: str = "half_up") -> DataFrame:
    """Treatments with units, days, coverage of their posology and of their specialty.

    The mean over a specialty weighs every posology by its dispensing rows
    (`weight='row'`) or equally (`weight='posology'`). Treatments without a finite
    coverage are dropped.
    """
    return coverage_of(treatment_sums(valid), weight, rounding)


def classified(treatments: DataFrame) -> DataFrame:
    """Treatments with a coverage class; a single dispensing has none and is dropped."""
    label = coverage_class(F.col("coverage"), F.col("days"))
    return (treatments.withColumn("coverage_class", label)
            .filter(F.col("coverage_class") != L.COVERAGE_SINGLE)
            .withColumn("class_order", level_order(F.col("coverage_class"), L.COVERAGE_LEVELS)))


def coverage_detail(treatments: DataFrame) -> DataFrame:
    """Raw table of the report: classified treatments without the posology's ratio."""
    return (treatments.drop("coverage_posology", "class_order").distinct()
            .withColumnRenamed("posology_days", "prescription_days"))


def coverage_by_drug(treatments: DataFrame) -> DataFrame:
    return (treatments.groupBy("med_group", "med_name", "coverage_class", "class_order")
            .agg(F.count(F.lit(1)).alias("n")))


def totals_by_drug(treatments: DataFrame) -> DataFrame:
    """Treatments per drug and class with the drug's total, and the axis of the group's chart.

    The axis ends at the next tick above the group's largest total; ticks stand a
    tenth of that total apart, rounded up to tens.
    """
    counts = coverage_by_drug(treatments)
    totals = counts.groupBy("med_group", "med_name").agg(F.sum("n").alias("total"))
    top = totals.groupBy("med_group").agg(F.max("total").alias("top"))
    breaks = round_up_to(F.col("top") / 100 * 10, 10)
    axis = (top.withColumn("breaks", breaks.cast("bigint"))
            .withColumn("axis_limit", round_up_to(F.col("top"), F.col("breaks")).cast("bigint"))
            .drop("top"))
    return join_on(join_on(counts, totals, ["med_group", "med_name"]), axis, ["med_group"])


def coverage_by_group(treatments: DataFrame) -> DataFrame:
    """Treatments per drug group and class, with the group's total and a chart label."""
    counts = (treatments.groupBy("med_group", "coverage_class", "class_order")
              .agg(F.count(F.lit(1)).alias("n")))
    return (counts.withColumn("label_text", count_label(F.col("n"), above=3))
            .withColumn("total", F.sum("n").over(Window.partitionBy("med_group"))))


def patients_by_group(treatments: DataFrame) -> DataFrame:
    """Distinct patients per drug group; a missing id counts as one patient."""
    return (treatments.groupBy("med_group")
            .agg(F.count_distinct(F.struct("nhc")).alias("patients")))


def patients_total(treatments: DataFrame) -> DataFrame:
    return (treatments.agg(F.count_distinct(F.struct("nhc")).alias("n"))
            .select(F.lit("Numero de pacients totals").alias("variable"), "n"))


def _class_counts(count: Column) -> list[Column]:
    """Sum of `count` per coverage class, absent classes as zero."""
    return [F.coalesce(F.sum(F.when(F.col("coverage_class") == level, count)), F.lit(0))
            .alias(f"n_{name}") for level, name in CLASS_NAMES.items()]


def _with_shares(wide: DataFrame, total: str, rounding: str) -> DataFrame:
    return wide.withColumns({f"pct_{name}": percent_text(round_to(
        F.try_divide(F.col(f"n_{name}").cast("double"), F.col(total)) * 100.0, 1, rounding))
        for name in CLASS_NAMES.values()})


def coverage_summary(treatments: DataFrame, rounding: str = "half_up") -> DataFrame:
    """Per drug group: treatments per class with shares, patients, treatments per patient.

    Treatments are counted per patient first, so one pass gives treatments and
    distinct patients.
    """
    per_patient = treatments.groupBy("med_group", "nhc").agg(
        *_class_counts(F.lit(1)), F.count(F.lit(1)).alias("treatments"))
    counts = [f"n_{name}" for name in CLASS_NAMES.values()] + ["treatments"]
    wide = per_patient.groupBy("med_group").agg(
        *[F.sum(c).alias(c) for c in counts], F.count(F.lit(1)).alias("patients"))
    return _with_shares(wide, "treatments", rounding).withColumn(
        "treatments_per_patient",
        round_to(F.try_divide(F.col("treatments").cast("double"), F.col("patients")), 1, rounding))


def coverage_summary_by_drug(treatments: DataFrame, rounding: str = "half_up") -> DataFrame:
    """Treatments per class with shares for every drug, all drug groups at once."""
    wide = treatments.groupBy("med_group", "med_name").agg(
        *_class_counts(F.lit(1)), F.count(F.lit(1)).alias("total"))
    return _with_shares(wide, "total", rounding)
