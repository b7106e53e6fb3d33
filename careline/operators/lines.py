"""Treatment lines: the ordered drug groups of patients who took several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careline.functions import labels as L
from careline.functions.rounding import mean_of_tenths, round_to, tenths
from careline.functions.semantics import join_on, order_key, sort_columns, strict
from careline.functions.timeparts import months_between
from careline.operators.dispensing import dispensing_order, one_group_patients


def multi_drug_patients(rows: DataFrame) -> DataFrame:
    """Dispensings of patients with more than one drug group, a missing one counting."""
    several = one_group_patients(rows).filter(F.col("naive") == L.NO).select("nhc")
    return join_on(rows, several, ["nhc"], "left_semi")


def treatment_lines(rows: DataFrame) -> DataFrame:
    """One row per patient and drug group, numbered by first appearance, with months.

    The dispensings are reduced to one row per patient and group first, so the
    window over a patient sees at most as many rows as there are drug groups.
    """
    first = order_key(*dispensing_order(rows))
    spans = rows.groupBy("nhc", "med_group").agg(
        F.min(first).alias("__order"), F.min("dispensed_at").alias("__from"),
        strict(F.max("dispensed_at"), "dispensed_at").alias("__to"))
    patient = Window.partitionBy("nhc")
    position = F.row_number().over(
        patient.orderBy("__order", *sort_columns("med_group")))
    return (spans.withColumn("groups", F.count(F.lit(1)).over(patient))
            .withColumn("position", position)
            .filter(F.col("groups") > 1)
            .select("nhc", "med_group", "position",
                    round_to(months_between(F.col("__from"), F.col("__to")), 1).alias("months")))


def treatment_paths(lines: DataFrame) -> DataFrame:
    """Per patient the lines as arrays and the path text, missing groups skipped."""
    entry = F.struct("position", "med_group", "months")
    return (lines.groupBy("nhc").agg(F.array_sort(F.collect_list(entry)).alias("lines"))
            .select("nhc",
                    F.concat_ws("+", F.transform("lines", lambda x: x["med_group"])).alias("path"),
                    F.transform("lines", lambda x: x["med_group"]).alias("drugs"),
                    F.transform("lines", lambda x: x["months"]).alias("durations")))


def paths_by_position(paths: DataFrame) -> DataFrame:
    """Drug group and months of every line of every patient, with the patient's path."""
    entry = F.arrays_zip("drugs", "durations")
    return (paths.select("nhc", "path", F.posexplode(entry).alias("i", "x"))
            .select("nhc", "path", (F.col("i") + 1).alias("position"),
                    F.col("x.drugs").alias("med_group"), F.col("x.durations").alias("months")))


def path_frequency(paths: DataFrame) -> DataFrame:
    return paths.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def _deviation(x: Column, rounding: str) -> Column:
    """Sample standard deviation of tenths as one-decimal value; NULL for one row.

    From exact sums, so that a halfway case rounds the same in every order.
    """
    n = F.count(x).cast("double")
    total, squares = F.sum(x.cast("double")), F.sum(x.cast("double") * x)
    variance = F.try_divide(n * squares - total * total, n * (n - 1))
    return round_to(F.sqrt(variance) / F.lit(10.0), 1, rounding)


def path_duration_stats(paths: DataFrame, rounding: str = "half_up") -> DataFrame:
    """Months per path and position, over the distinct duration vectors of the path."""
    vectors = paths.groupBy("path", "drugs", "durations").agg(F.count(F.lit(1)).alias("k"))
    per_path = vectors.groupBy("path").agg(F.sum("k").alias("n"))
    entry = F.arrays_zip("drugs", "durations")
    months = F.col("x.durations")
    stats = (vectors.select("path", F.posexplode(entry).alias("i", "x"))
             .groupBy("path", (F.col("i") + 1).alias("position"), F.col("x.drugs").alias("med_group"))
             .agg(strict(mean_of_tenths(F.sum(tenths(months)), F.count(months)), months)
                  .alias("mean_months"),
                  strict(_deviation(tenths(months), rounding), months).alias("sd_months"),
                  strict(F.min(months), months).alias("min_months"),
                  strict(F.max(months), months).alias("max_months")))
    return join_on(stats, per_path, ["path"])


def top_paths(frequency: DataFrame, k: int = 20) -> DataFrame:
    """The most frequent paths; ties go by path text."""
    return frequency.orderBy(F.desc("n"), "path").limit(k)


def _path_drugs(paths: DataFrame) -> DataFrame:
    """Distinct paths with their drug groups and the patients sharing the path text."""
    counts = paths.groupBy("path", "drugs").agg(F.count(F.lit(1)).alias("k"))
    return counts.withColumn("n", F.sum("k").over(Window.partitionBy("path"))).drop("k")


def line_position_frequency(paths: DataFrame) -> DataFrame:
    """Patients per drug group and line position, zero where a group never stands."""
    found = (_path_drugs(paths).select("n", F.posexplode("drugs").alias("i", "med_group"))
             .filter(F.col("med_group").isNotNull())
             .groupBy("med_group", (F.col("i") + 1).alias("position"))
             .agg(F.sum("n").alias("n")))
    deepest = F.max("position").over(Window.partitionBy(F.lit(1)))
    grid = (found.withColumn("deepest", deepest)
            .groupBy("med_group").agg(F.max("deepest").alias("deepest"),
                                      F.map_from_entries(F.collect_list(F.struct("position", "n")))
                                      .alias("counts")))
    return (grid.select("med_group", "counts",
                        F.explode(F.sequence(F.lit(1), "deepest")).alias("position"))
            .select("med_group", "position",
                    F.coalesce(F.try_element_at("counts", F.col("position")), F.lit(0)).alias("n")))


def line_flows(paths: DataFrame, k: int = 20) -> DataFrame:
    """Patients going from each first to each second drug group, in the top paths."""
    chosen = top_paths(path_frequency(paths), k).select("path")
    drugs = join_on(_path_drugs(paths), chosen, ["path"], "left_semi")
    return (drugs.groupBy(F.get("drugs", F.lit(0)).alias("first_drug"),
                          F.get("drugs", F.lit(1)).alias("second_drug"))
            .agg(F.sum("n").alias("n")))
