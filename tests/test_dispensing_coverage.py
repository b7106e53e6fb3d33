"""Dispensings, prescriptions, coverage and dosing on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from careline.functions import labels as L
from careline.operators import coverage as V
from careline.operators import dispensing as D
from careline.operators import dosing as O
from careline.operators import lines as N

DAY0 = dt.datetime(2020, 1, 1)


def day(n):
    return None if n is None else DAY0 + dt.timedelta(days=n)


def dispensings(spark, rows):
    """Rows of (patient, drug, code, day, quantity)."""
    return spark.createDataFrame(
        [(p, d, d, d, c, day(t), q, i) for i, (p, d, c, t, q) in enumerate(rows)],
        "nhc_raw string, med_group string, med_name string, med_code string, national_code int, "
        "dispensed_at timestamp_ntz, qty double, tie1 int")


def prescriptions(spark, rows):
    """Rows of (patient, drug, code, id, from, to, posology)."""
    return spark.createDataFrame(
        [(p, p, i, d, c, 1.0, "F", "f", day(a), day(b), x) for p, d, c, i, a, b, x in rows],
        "nhc string, presc_nhc_raw string, prescription_id string, med_code string, "
        "presc_national_code int, dose double, freq_code string, freq_desc string, "
        "valid_from timestamp_ntz, valid_to timestamp_ntz, posology_days double")


def test_ids(spark):
    rows = dispensings(spark, [("000120", "A", 1, 0, 1.0), ("120", "A", 1, 1, 1.0),
                               ("N/D", "A", 1, 2, 1.0), (None, "A", 1, 3, 1.0)])
    kept = D.dispensed(D.valid_ids(rows, "nhc_raw"))
    assert [r.nhc for r in kept.collect()] == ["120", "120"]


def test_gaps_use_raw_id_and_empty_dispensings(spark):
    rows = dispensings(spark, [("0120", "A", 1, 0, 1.0), ("120", "A", 1, 5, 1.0), ("120", "A", 1, 9, 0.0),
                               ("120", "A", 1, 20, -1.0), ("120", "A", 1, 30, None)])
    got = {r.tie1: r.gap_days for r in D.dispensing_gaps(rows).collect()}
    assert got == {0: None, 1: None, 3: 11}


def test_matched_and_unmatched_make_the_join(spark):
    rows = D.dispensed(dispensings(spark, [("1", "A", 1, 0, 1.0), ("1", "B", 1, 0, 1.0),
                                           ("2", None, 1, 0, 1.0), ("3", "A", 1, 0, 1.0)]))
    presc = prescriptions(spark, [("1", "A", 1, "x", 0, 9, 1.0), ("1", "A", 1, None, 0, 9, 1.0),
                                  ("2", None, 1, "y", 0, 9, 1.0)])
    joined = D.dispensing_prescriptions(rows, presc)
    parts = D.matched_dispensings(rows, presc).unionByName(D.unmatched_dispensings(rows, presc))
    assert joined.count() == parts.count() == 5
    assert joined.select(*sorted(joined.columns)).exceptAll(
        parts.select(*sorted(joined.columns))).count() == 0
    assert {r.tie1 for r in D.unmatched_dispensings(rows, presc).collect()} == {0, 1, 3}


def test_overlapping_prescriptions_count_twice(spark):
    rows = D.dispensed(dispensings(spark, [("1", "A", 1, 3, 2.0), ("1", "A", 1, 3, 2.0), ("1", "A", 1, 40, 2.0)]))
    presc = prescriptions(spark, [("1", "A", 1, "x", 0, 10, 1.0), ("1", "A", 1, "y", 0, None, 1.0),
                                  ("1", "A", 1, "z", 0, None, 1.0)])
    valid = D.valid_dispensings(rows, presc, "2020-01-20")
    # equal dispensings and equal prescriptions collapse, the late one is past the end
    assert valid.count() == 2


def valid_frame(spark, rows):
    return spark.createDataFrame(
        [(p, "G", "D", c, day(t), q, "f", x, day(0), None) for p, c, x, t, q in rows],
        "nhc string, med_group string, med_name string, national_code int, "
        "dispensed_at timestamp_ntz, qty double, freq_desc string, posology_days double, "
        "valid_from timestamp_ntz, valid_to timestamp_ntz")


def test_coverage(spark):
    got = V.coverage_ratio(valid_frame(spark, [
        ("zero", 1, 0.0, 0, 5.0), ("zero", 1, 0.0, 10, 5.0),     # posology zero: no coverage
        ("once", 1, 0.0, 0, 5.0),                                # zero days: dropped
        ("same", 1, 7.0, 0, 5.0), ("same", 1, 7.0, 0, 6.0),      # same day: dropped
        ("none", 1, None, 0, 5.0), ("none", 1, None, 9, 5.0),    # no posology: dropped
        ("full", 1, 7.0, 0, 1.0), ("full", 1, 7.0, 14, 1.0),     # 2 units of 7 days over 14
        ("gap", 1, 7.0, 0, None), ("gap", 1, 7.0, 14, 1.0),      # unknown quantity: dropped
    ])).collect()
    assert {r.nhc: (r.units, r.days, r.coverage) for r in got} == {
        "zero": (10.0, 10, 0.0), "full": (2.0, 14, 1.0)}


def test_mean_coverage_weights(spark):
    rows = [("p", 1, 1.0, t, 1.0) for t in (0, 1, 2, 10)] + [("p", 1, 5.0, 0, 1.0), ("p", 1, 5.0, 10, 1.0)]
    # posology 1: 4 units over 10 days = 0.4 in 4 rows; posology 5: 10 / 10 = 1.0 in 2 rows
    by_row = {r.coverage for r in V.coverage_ratio(valid_frame(spark, rows)).collect()}
    by_posology = {r.coverage for r in V.coverage_ratio(valid_frame(spark, rows), "posology").collect()}
    assert (by_row, by_posology) == ({0.6}, {0.7})


def test_single_dispensing_class_is_dropped(spark):
    rated = V.classified(V.coverage_ratio(valid_frame(spark, [
        ("a", 1, 1.0, 0, 1.0), ("a", 1, 1.0, 1, 1.0), ("b", 1, 1.0, 0, 1.0), ("b", 1, 1.0, 4, 1.0)])))
    assert [(r.nhc, r.coverage_class, r.class_order) for r in rated.collect()] == [("b", "0.5-0.8", 2)]
    summary = V.coverage_summary(rated).first()
    assert (summary.n_05_to_08, summary.pct_05_to_08, summary.pct_from_09) == (1, "100%", "0%")


def test_lines_and_paths(spark):
    rows = D.dispensed(dispensings(spark, [
        ("1", "A", 1, 0, 1.0), ("1", "B", 1, 5, 1.0), ("1", "A", 1, 31, 1.0), ("2", "A", 1, 0, 1.0),
        ("3", "B", 1, 0, 1.0), ("3", None, 1, 2, 1.0), ("3", "A", 1, 9, 1.0)]))
    lines = N.treatment_lines(rows)
    got = {(r.nhc, r.position): (r.med_group, r.months) for r in lines.collect()}
    assert got == {("1", 1): ("A", 1.0), ("1", 2): ("B", 0.0), ("3", 1): ("B", 0.0),
                   ("3", 2): (None, 0.0), ("3", 3): ("A", 0.0)}
    paths = N.treatment_paths(lines)
    assert {r.path: r.n for r in N.path_frequency(paths).collect()} == {"A+B": 1, "B+A": 1}
    grid = {(r.med_group, r.position): r.n for r in N.line_position_frequency(paths).collect()}
    assert grid == {("A", 1): 1, ("A", 2): 0, ("A", 3): 1, ("B", 1): 1, ("B", 2): 1, ("B", 3): 0}
    assert N.multi_drug_patients(rows).select("nhc").distinct().count() == 2


def test_dose_flags_pool_unmatched_patients(spark):
    rows = D.dispensed(dispensings(spark, [("1", "A", 1, 0, 1.0), ("2", "A", 1, 0, 1.0),
                                           ("3", "A", 1, 0, 1.0), ("4", "B", 1, 0, 1.0)]))
    presc = prescriptions(spark, [("1", "A", 1, "x", 0, 9, 1.0), ("1", "A", 1, "y", 0, 9, 1.0),
                                  ("2", "A", 1, "z", 0, 9, 1.0)])
    presc = presc.withColumn("dose", F.when(F.col("prescription_id") == "y", 2.0).otherwise(1.0))
    got = {(r.nhc, r.dose): (r.naive, r.dose_optimised)
           for r in O.dose_optimised(rows, presc, "A").collect()}
    # patients 3 and 4 share the missing prescription id, so 3 counts as taking A and B
    assert got == {("1", 1.0): (L.YES, L.YES), ("1", 2.0): (L.YES, L.YES), ("2", 1.0): (L.YES, L.NO),
                   ("3", None): (L.NO, L.NO)}
    per_patient = O.patient_variants(O.dose_variant_order(O.dose_variants(rows, presc, "A")))
    assert [(r.nhc, r.combination) for r in per_patient.collect()] == [("1", "A_1_F + A_2_F")]
    assert "A_2_F" in {r.variant for r in O.dose_variants_by_position(per_patient).filter("position = 2").collect()}


def test_unknown_weight_is_refused(spark):
    with pytest.raises(ValueError):
        V.coverage_ratio(valid_frame(spark, [("a", 1, 1.0, 0, 1.0)]), "other")
