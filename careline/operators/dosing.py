"""Dose changes of one drug: which patients had several doses or frequencies.

Flags and variants depend only on which drugs and prescriptions a patient has,
not on how often they were dispensed, so both sides are reduced to distinct keys
before they are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from careline.functions import labels as L
from careline.functions.semantics import join_on, single_valued, sort_columns
from careline.functions.text import number_text, or_na
from careline.operators.dispensing import MATCH, one_group_patients, present

_FREQUENCY = ["dose", "freq_code", "freq_desc"]


def _flags(pairs: DataFrame, drug: str) -> tuple[DataFrame, DataFrame]:
    """(naive flag per prescription-side patient, dose flag per patient and drug code)."""
    naive = one_group_patients(pairs, "presc_nhc_raw")
    doses = (pairs.filter(F.col("med_group") == drug).groupBy("presc_nhc_raw", "med_code")
             .agg(F.when(single_valued("dose", "freq_code"), L.NO).otherwise(L.YES)
                  .alias("dose_optimised")))
    return naive, doses


def key_pairs(rows: DataFrame, prescriptions: DataFrame) -> DataFrame:
    """Distinct drugs of patients with the doses and frequencies prescribed to them, if any."""
    left = rows.select(*present(rows, [*MATCH, "med_group", "med_name"])).distinct()
    right = prescriptions.select(*MATCH, "presc_nhc_raw", *_FREQUENCY).distinct()
    return join_on(left, right, MATCH, "left")


def dose_optimised(rows: DataFrame, prescriptions: DataFrame, drug: str,
                   pairs: DataFrame | None = None) -> DataFrame:
    """Dispensings of `drug` with every dose and frequency, flagged naive and dose-optimised.

    `prescriptions` counts those of the same patient, drug, dose and frequency, 0 without any:
    a dispensing has a row for each regimen, not for each prescription. The flags go by the
    prescription-side patient id, so dispensings without prescription form one group.
    `pairs` are the `key_pairs`, where they are at hand.
    """
    naive, doses = _flags(key_pairs(rows, prescriptions) if pairs is None else pairs, drug)
    mine = rows.filter(F.col("med_group") == drug).select(*present(rows, [
        "nhc", "cip", "med_code", "med_name", "dispensed_at", "qty"]))
    # only prescriptions of the drug's own codes can meet these rows
    codes = mine.select("med_code").distinct()
    regimens = (join_on(prescriptions, codes, ["med_code"], "left_semi")
                .groupBy(*MATCH, "presc_nhc_raw", *_FREQUENCY)
                .agg(F.count(F.lit(1)).alias("prescriptions")))
    counted = (join_on(mine, regimens, MATCH, "left")
               .withColumn("prescriptions", F.coalesce("prescriptions", F.lit(0))))
    flagged = join_on(join_on(counted, naive, ["presc_nhc_raw"], "left"),
                      doses, ["presc_nhc_raw", "med_code"], "left")
    return flagged.drop("presc_nhc_raw")


def dose_variants(rows: DataFrame, prescriptions: DataFrame, drug: str,
                  pairs: DataFrame | None = None) -> DataFrame:
    """Distinct drug, dose and frequency combinations of dose-optimised patients."""
    pairs = key_pairs(rows, prescriptions) if pairs is None else pairs
    _, doses = _flags(pairs, drug)
    optimised = doses.filter(F.col("dose_optimised") == L.YES).drop("dose_optimised")
    mine = join_on(pairs.filter(F.col("med_group") == drug), optimised,
                   ["presc_nhc_raw", "med_code"], "left_semi")
    variant = F.concat_ws("_", or_na(F.col("med_name")), number_text(F.col("dose")),
                          or_na(F.col("freq_code")))
    return (mine.select("nhc", "med_code", "med_name", *_FREQUENCY).distinct()
            .withColumn("variant", variant))


def dose_variant_order(variants: DataFrame) -> DataFrame:
    """Variants numbered within a patient, by drug, dose and frequency.

    A patient has at most as many variants as the drug has doses and frequencies.
    """
    order = ["med_code", "med_name", "dose", "freq_code"]
    distinct = variants.select("nhc", "variant", *order).distinct()
    once = distinct.groupBy("nhc", "variant").agg(
        F.min(F.struct(*[F.struct(F.col(c).isNull(), F.col(c)) for c in order])).alias("__order"))
    numbered = F.row_number().over(
        Window.partitionBy("nhc").orderBy("__order", *sort_columns("variant")))
    return once.select("nhc", "variant", numbered.alias("position"))


def patient_variants(numbered: DataFrame) -> DataFrame:
    """Per patient the ordered variants and their combination as text."""
    entry = F.array_sort(F.collect_list(F.struct("position", "variant")))
    return (numbered.groupBy("nhc").agg(F.transform(entry, lambda x: x["variant"]).alias("variants"))
            .withColumn("combination", F.array_join("variants", " + ")))


def dose_variants_by_position(per_patient: DataFrame) -> DataFrame:
    """Every variant of every patient with its position and the patient's combination."""
    return (per_patient.select("nhc", "combination", F.posexplode("variants").alias("i", "variant"))
            .select("nhc", "combination", (F.col("i") + 1).alias("position"), "variant"))


def dose_combinations(per_patient: DataFrame) -> DataFrame:
    """Patients per combination of variants."""
    return per_patient.groupBy("combination").agg(F.count(F.lit(1)).alias("patients"))
