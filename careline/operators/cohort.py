"""Patients who only ever took one drug group: description and tests.

One aggregation reduces the dispensings to a row per patient; tables and tests
are built from those rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careline.functions import labels as L
from careline.functions.bands import age_band, level_order
from careline.functions.rounding import round_to, tenths
from careline.functions.semantics import join_on, single_valued
from careline.functions.tails import chisq_p_value


def all_cells() -> Window:
    """Window over a whole summary table; its rows are few, one per drug and level."""
    return Window.partitionBy(F.lit(1))


def naive_rows(valid: DataFrame) -> DataFrame:
    """Valid dispensings of patients with a single drug group."""
    naive = (valid.groupBy("nhc").agg(single_valued("med_group").alias("one"))
             .filter("one").select("nhc"))
    return join_on(valid, naive, ["nhc"], "left_semi")


def demographics(patients: DataFrame) -> DataFrame:
    """Distinct records per trimmed patient id; contradicting records stay apart."""
    return patients.select(F.trim("nhc").alias("nhc"), "sex", "birth_year").distinct()


def _aged(frame: DataFrame) -> DataFrame:
    return (frame.withColumn("age", F.col("start_year") - F.col("birth_year"))
                 .withColumn("age_band", age_band(F.col("age")))
                 .withColumn("age_order", level_order(F.col("age_band"), L.AGE_LEVELS)))


def cohort_patients(valid: DataFrame, patients: DataFrame, copies: str | None = None) -> DataFrame:
    """Naive patients with group, dispensing rows, start year, sex and age band.

    `copies` names a column that says for how many dispensing rows a row stands.
    """
    ts = F.col("dispensed_at")
    per_patient = (valid.groupBy("nhc")
                   .agg(single_valued("med_group").alias("one"),
                        F.min("med_group").alias("med_group"),
                        (F.sum(copies) if copies else F.count(F.lit(1))).alias("n_rows"),
                        F.year(F.min(ts)).cast("int").alias("start_year"))
                   .filter("one").drop("one"))
    return _aged(join_on(per_patient, demographics(patients), ["nhc"], "left"))


def cohort_rows(valid: DataFrame, people: DataFrame) -> DataFrame:
    """Dispensings of the naive cohort with the columns of `cohort_patients`."""
    return join_on(valid, people.drop("med_group", "n_rows"), ["nhc"])


def _patients() -> Column:
    return F.count_distinct(F.struct("nhc"))


def with_totals(table: DataFrame, label: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """Append a row that sums the rows shown, shares included."""
    numeric = [c for c in table.columns if c != label]
    sums = {**{c: F.sum(c) for c in numeric}, **(sums or {})}
    totals = table.agg(*[sums[c].cast(table.schema[c].dataType).alias(c) for c in numeric])
    return table.unionByName(totals.withColumn(label, F.lit(L.TOTALS)))


def patients_by_drug(cohort: DataFrame, rounding: str = "half_up") -> DataFrame:
    counts = cohort.groupBy("med_group").agg(_patients().alias("patients"))
    share = F.col("patients").cast("double") / F.sum("patients").over(all_cells()) * 100.0
    return counts.withColumn("pct", round_to(share, 1, rounding))


def cohort_by_drug(cohort: DataFrame, rounding: str = "half_up") -> DataFrame:
    """Patients per drug group with their share, and a totals row."""
    return with_totals(patients_by_drug(cohort, rounding), "med_group",
                       {"pct": F.sum(tenths(F.col("pct"))) / F.lit(10.0)})


def _spread(cohort: DataFrame, column: str, columns: dict[str, str], value: Column,
            missing: str | None) -> DataFrame:
    """One row per drug group, one column per level, absent cells as zero."""
    cells = cohort.groupBy("med_group", column).agg(value.alias("v"))
    wide = [F.coalesce(F.sum(F.when(F.col(column) == level, F.col("v"))), F.lit(0)).alias(name)
            for level, name in columns.items()]
    if missing:
        wide.append(F.coalesce(F.sum(F.when(F.col(column).isNull(), F.col("v"))), F.lit(0))
                    .alias(missing))
    return cells.groupBy("med_group").agg(*wide)


AGE_COLUMNS = dict(zip(L.AGE_LEVELS, ("under_20", "from_20_to_40", "from_41_to_50",
                                      "from_51_to_60", "from_61_to_70", "from_71_to_80",
                                      "over_80", "unavailable")))


def level_columns(levels) -> dict[str, str]:
    return {level: f"n_{level.lower()}" for level in levels}


def cohort_by_drug_sex(cohort: DataFrame, levels=("F", "M")) -> DataFrame:
    """Patients per drug group and sex; an unknown sex has its own column."""
    wide = _spread(cohort, "sex", level_columns(levels), _patients(), "n_unknown")
    return with_totals(wide, "med_group")


def cohort_by_drug_age(cohort: DataFrame) -> DataFrame:
    """Patients per drug group and age band, bands in age order."""
    return with_totals(_spread(cohort, "age_band", AGE_COLUMNS, _patients(), None), "med_group")


# Tests on dispensing rows -----------------------------------------------------

def crosstab(cohort: DataFrame, column: str, levels, excluded_drug: str | None = None) -> DataFrame:
    """Dispensing rows per drug group and level; zero cells of known levels stay.

    Rows with a missing drug group or level are not counted.
    """
    rows = cohort.filter(F.col("med_group").isNotNull() & F.col(column).isNotNull())
    if excluded_drug is not None:
        rows = rows.filter(F.col("med_group") != excluded_drug)
    names = {level: f"c{i}" for i, level in enumerate(levels)}
    wide = _spread(rows, column, names, F.sum("n_rows"), None)
    cells = F.array(*[F.struct(F.lit(level).alias("level"), F.col(name).alias("n"))
                      for level, name in names.items()])
    return wide.select("med_group", F.explode(cells).alias("c")).select("med_group", "c.*")


def chisq_goodness(cohort: DataFrame) -> DataFrame:
    """Whether the drug groups have equal shares of the dispensing rows."""
    counts = (cohort.filter(F.col("med_group").isNotNull()).groupBy("med_group")
              .agg(F.sum("n_rows").cast("double").alias("o")))
    expected = F.sum("o").over(all_cells()) / F.count(F.lit(1)).over(all_cells())
    return (counts.withColumn("e", expected)
            .agg(F.sum((F.col("o") - F.col("e")) * (F.col("o") - F.col("e")) / F.col("e"))
                 .alias("chisq"),
                 (F.count(F.lit(1)) - 1).alias("df")))


def chisq_independence(cells: DataFrame, empty_levels: str = "drop") -> DataFrame:
    """Independence of drug group and level, from the cells of `crosstab`.

    A level without rows has an expected count of zero: `'drop'` leaves it out,
    `'keep'` lets it make the statistic NaN. A 2 x 2 table gets the continuity
    correction.
    """
    if empty_levels not in ("drop", "keep"):
        raise ValueError(f"unknown rule {empty_levels!r}")
    by_drug, by_level = Window.partitionBy("med_group"), Window.partitionBy("level")
    o = F.col("n").cast("double")
    table = (cells.withColumns({"o": o, "r": F.sum(o).over(by_drug),
                                "c": F.sum(o).over(by_level), "total": F.sum(o).over(all_cells())})
             .withColumn("e", F.col("r") * F.col("c") / F.col("total")))
    if empty_levels == "drop":
        table = table.filter(F.col("c") > 0)
    table = (table.withColumn("rows", F.size(F.collect_set("med_group").over(all_cells())))
                  .withColumn("cols", F.size(F.collect_set("level").over(all_cells()))))
    distance = F.abs(F.col("o") - F.col("e"))
    corrected = F.when((F.col("rows") == 2) & (F.col("cols") == 2),
                       distance - F.least(F.lit(0.5), distance)).otherwise(distance)
    term = F.when(F.col("e") == 0, F.lit(float("nan"))).otherwise(
        corrected * corrected / F.col("e"))
    return table.agg(F.sum(term).alias("chisq"),
                     ((F.max("rows") - 1) * (F.max("cols") - 1)).cast("bigint").alias("df"))


def with_p_value(test: DataFrame) -> DataFrame:
    return test.withColumn("p_value", chisq_p_value(F.col("chisq"), F.col("df").cast("double")))
