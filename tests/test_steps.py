"""Process outcomes on hand-made processes."""

import datetime as dt

import pytest

from careline.functions import labels as L
from careline.operators import steps as S
from careline.operators import summary as M

SCHEMA = ("nhc string, process_id bigint, drug_code string, drug_name string, "
          "process_start timestamp_ntz, process_end timestamp_ntz, step_ts timestamp_ntz, "
          "step_no int, score double")


def frame(spark, rows):
    """Rows of (patient, process, drug, day offset, score); steps numbered in order."""
    start = dt.datetime(2019, 1, 1)
    data = [(p, k, d, d, start, start + dt.timedelta(days=90),
             None if off is None else start + dt.timedelta(days=off), i, s)
            for i, (p, k, d, off, s) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def outcome(spark, rows, **options):
    steps = frame(spark, rows)
    table = S.with_best_change(S.process_table(steps, **options), steps)
    return {r.process_id: r for r in table.collect()}


def test_results(spark):
    got = outcome(spark, [
        ("a", 1, "X", 0, 5.0), ("a", 1, "X", 40, 3.0), ("a", 1, "X", 80, 4.0),    # better
        ("b", 2, "X", 0, 4.0), ("b", 2, "X", 40, 6.0), ("b", 2, "X", 50, 5.0),    # worse
        ("c", 3, "X", 0, 4.0), ("c", 3, "X", 40, 4.0), ("c", 3, "X", 41, 4.0),    # equal
        ("d", 4, "X", 0, 4.0),                                                    # single
        ("e", 5, "X", 0, 5.0), ("e", 5, "X", 40, None), ("e", 5, "X", 80, 4.0),   # missing
    ])
    assert [got[i].result for i in range(1, 6)] == [
        L.SUCCESS, L.FAILURE, L.NO_CHANGE, L.NO_FOLLOW_UP, None]
    assert [got[i].best_change for i in range(1, 6)] == [-2.0, 1.0, float("inf"), float("inf"), None]
    assert got[1].days_to_minimum == 40 and got[5].days_to_minimum == 80


def test_outlier_is_baseline_then_removed(spark):
    rows = [("a", 1, "X", 0, 45.0), ("a", 1, "X", 40, 6.0), ("a", 1, "X", 80, 7.0)]
    after, before = outcome(spark, rows), outcome(spark, rows, outlier_rule="before")
    assert (after[1].n, after[1].result, after[1].best_change) == (3, L.SUCCESS, -39.0)
    assert (before[1].n, before[1].result, before[1].best_change) == (2, L.FAILURE, 1.0)
    steps = frame(spark, rows)
    assert S.step_frame(steps, S.process_table(steps)).count() == 2
    assert S.outliers(steps).count() == 1


def test_start_error(spark):
    got = outcome(spark, [
        ("a", 1, "X", 0, 5.0), ("a", 1, "X", 10, 3.0), ("a", 1, "X", 60, 2.0),  # low in month 0
        ("b", 2, "X", 0, 5.0), ("b", 2, "X", 40, 3.0),                          # low later
        ("c", 3, "X", 0, 3.0), ("c", 3, "X", 40, 5.0),                          # low first
        ("d", 4, "X", 0, 5.0), ("d", 4, "X", 10, None),                         # unknown in month 0
        ("e", 5, "X", 0, 5.0), ("e", 5, "X", 40, None),                         # unknown later
    ])
    assert [got[i].start_error for i in range(1, 6)] == [L.YES, L.NO, L.YES, None, L.NO]


def test_pure_treatment_counts_missing_code(spark):
    steps = frame(spark, [
        ("a", 1, "X", 0, 5.0), ("a", 2, None, 0, 5.0), ("b", 3, "X", 0, 5.0), ("b", 4, "X", 9, 5.0),
        ("c", 5, None, 0, 5.0), ("d", 6, "X", 0, 5.0), ("d", 6, "Y", 9, 5.0)])
    got = {r.nhc: r.pure_treatment for r in S.pure_patients(steps).collect()}
    assert got == {r.nhc: r.pure_treatment for r in S.process_table(steps).collect()}
    assert got == {"a": L.NO, "b": L.YES, "c": L.YES, "d": L.NO}


def test_unknown_result_hides_group_counts(spark):
    steps = frame(spark, [
        ("a", 1, "X", 0, 5.0), ("a", 1, "X", 40, 4.0),
        ("b", 2, "X", 0, 5.0), ("b", 2, "X", 40, None), ("b", 2, "X", 80, 4.0),
        ("c", 3, "Y", 0, 5.0), ("c", 3, "Y", 40, 4.0), ("d", 4, "Y", 0, 5.0), ("d", 4, "Y", 40, 6.0),
        ("e", 5, "Y", 0, 5.0)])
    summary = M.outcome_summary(S.process_outcomes(S.clean(S.process_table(steps)), steps))
    got = {r.drug_name: r for r in summary.collect()}
    assert got["X"].n_success is None and got["X"].pct_success is None
    assert (got["Y"].n_success, got["Y"].n_failure, got["Y"].n_no_change) == (1, 1, 0)
    assert (got["Y"].pct_success, got["Y"].mean_days_to_minimum) == (50.0, 40.0)


def test_undated_step_leaves_span_open(spark):
    spans = S.followup_span(frame(spark, [
        ("a", 1, "X", 0, 5.0), ("a", 1, "X", 40, 4.0), ("b", 2, "X", 0, 5.0), ("b", 2, "X", None, 4.0)]), 2020)
    assert {r.nhc: r.followup_days for r in spans.collect()} == {"a": 40, "b": None}


def test_row_order_and_partitions_do_not_matter(spark):
    rows = [(f"p{i % 7}", i % 7, "X", (i * 37) % 100, float(3 + (i * 13) % 6)) for i in range(60)]
    steps = frame(spark, rows)
    shuffled = steps.orderBy("score").repartition(5)
    for build in (lambda s: S.process_table(s).drop("variants"), lambda s: S.step_changes(s),
                  lambda s: S.followup_gaps(s, 2020)):
        assert build(steps).exceptAll(build(shuffled)).count() == 0


def test_unknown_options_are_refused(spark):
    with pytest.raises(ValueError):
        S.process_table(frame(spark, []), outlier_rule="sometimes")
