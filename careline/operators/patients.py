"""Patients whose rows fit one task, and the few whose rows do not.

Where both sides of a join and all groups after it belong to a patient, rows dealt out by patient meet,
and are grouped, without another exchange. A patient with more than `LONGEST` rows, or without id, goes
through the operators that cut a patient's rows. What is returned is the union of both, so all rows count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careline.functions.semantics import sort_columns
from careline.operators.dispensing import DISPENSED, MATCH, PRESCRIBED, point_in_time_posology, present
from careline.operators.intervals import closed_end
from careline.operators.survival import SUBJECT
from careline.session import written

#: Rows of a patient that are compared within one task.
LONGEST = 500


def long_patients(rows: DataFrame, key: str, longest: int = LONGEST) -> DataFrame:
    """Ids with more than `longest` rows, written; at most one for that many rows."""
    return written(rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
                   .filter(F.col("__n") > longest).select(F.col(key).alias("__long")), "long")


def split(rows: DataFrame, long: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of short patients, rows of long ones and of those without id).

    Where there are no long ones, nothing is left of either join, and of the second table only what has no id.
    """
    known, ids, on = rows.filter(F.col(key).isNotNull()), F.broadcast(long), F.col(key) == F.col("__long")
    return (known.join(ids, on, "left_anti"),
            known.join(ids, on).drop("__long").unionByName(rows.filter(F.col(key).isNull())))


def same(a: str, b: str) -> Column:
    """Equal or both missing, in a form that leaves the join to the patient alone."""
    return F.coalesce(F.col(a) == F.col(b), F.col(a).isNull() & F.col(b).isNull())


def valid_within(rows: DataFrame, prescriptions: DataFrame, as_of: str) -> DataFrame:
    """`valid_dispensings` of short patients: a patient's rows are all compared."""
    left = rows.select(*present(rows, DISPENSED)).distinct()
    right = (prescriptions.filter(F.col("prescription_id").isNotNull())
             .select(*MATCH, *PRESCRIBED).distinct().withColumnsRenamed({c: f"__r_{c}" for c in MATCH}))
    at = F.col("dispensed_at")
    on = ((F.col("nhc") == F.col("__r_nhc")) & same("med_code", "__r_med_code")
          & (at >= F.col("valid_from")) & (at <= closed_end(F.col("valid_to"), as_of)))
    return left.join(right, on).select(*left.columns, *PRESCRIBED)


def pairs_within(rows: DataFrame, prescriptions: DataFrame, how: str = "left") -> DataFrame:
    """`dispensing_prescriptions` of short patients, with `how="inner"` their `matched_dispensings`."""
    if how == "inner":
        prescriptions = prescriptions.filter(F.col("prescription_id").isNotNull())
    right = prescriptions.withColumnsRenamed({c: f"__r_{c}" for c in MATCH})
    on = (F.col("nhc") == F.col("__r_nhc")) & same("med_code", "__r_med_code")
    return rows.join(right, on, how).drop(*[f"__r_{c}" for c in MATCH])


def naive_within(instants: DataFrame) -> DataFrame:
    """`cohort.naive_rows` of short patients, whose rows lie together: nothing is exchanged for it."""
    patient, group = Window.partitionBy("nhc"), F.col("med_group")
    known = F.count(group).over(patient)
    one = (F.min(group).over(patient).eqNullSafe(F.max(group).over(patient))
           & ((known == 0) | (known == F.count(F.lit(1)).over(patient))))
    return instants.withColumn("__one", one).filter("__one").drop("__one")


def cohort_within(instants: DataFrame, people: DataFrame) -> DataFrame:
    """`cohort.cohort_rows` of short patients, who all have an id: dealt out by it."""
    return instants.join(people.drop("med_group", "n_rows"), "nhc").select(
        *instants.columns, *[c for c in people.columns if c not in ("nhc", "med_group", "n_rows")])


def ends_within(counted: DataFrame) -> DataFrame:
    """`survival.with_ends` of short patients: windows inside a patient."""
    subject = Window.partitionBy(*SUBJECT)
    order = subject.orderBy(*sort_columns("dispensed_at"))
    return counted.withColumns({"before": F.lag("dispensed_at").over(order),
                                "first": F.min("dispensed_at").over(subject),
                                "final": F.lead(F.lit(1)).over(order).isNull()})


def running_max_within(df: DataFrame, keys: list[str], order: list[str], new: str,
                       value: Column) -> DataFrame:
    """`ordered.with_running_max` where no key has many rows: one window over a key."""
    before = (Window.partitionBy(*keys).orderBy(*sort_columns(*order))
              .rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn(new, F.max(value).over(before))


def posology_within(rows: DataFrame, prescriptions: DataFrame, as_of: str | None) -> DataFrame:
    """`point_in_time_posology` of short patients."""
    return point_in_time_posology(rows, prescriptions, as_of, running_max_within)


def number_key(id_: Column) -> Column:
    """An id as a number in one spelling, so that ids equal as numbers lie together."""
    return (id_.try_cast("double") + F.lit(0.0)).cast("string")


def by_code_within(rows: DataFrame, prescriptions: DataFrame, as_of: str | None) -> DataFrame:
    """`interval_join_by_code` of short patients whose ids are numbers."""
    def numbered(frame: DataFrame, code: str) -> DataFrame:
        return frame.withColumns({"__nhc": number_key(F.col("nhc")),
                                  "__code": F.col(code).cast("string").try_cast("double")})

    own = present(rows, DISPENSED)
    known = (numbered(prescriptions.filter(F.col("prescription_id").isNotNull()), "presc_national_code")
             .select(F.col("__nhc").alias("__k_key"), *[F.col(c).alias(f"__k_{c}") for c in MATCH]).distinct())
    left = (numbered(rows.select(*own), "national_code")
            .join(known, (F.col("__nhc") == F.col("__k_key")) & same("nhc", "__k_nhc")
                  & same("med_code", "__k_med_code"), "left_semi").distinct())
    right = numbered(prescriptions, "presc_national_code").select(
        F.col("__nhc").alias("__r_nhc"), F.col("__code").alias("__r_code"),
        "posology_days", "valid_from", "valid_to")
    at = F.col("dispensed_at")
    on = ((F.col("__nhc") == F.col("__r_nhc"))
          & (at >= F.col("valid_from")) & (at <= closed_end(F.col("valid_to"), as_of))
          & same("__code", "__r_code"))
    return left.join(right, on).select(*own, "posology_days", "valid_from", "valid_to")
