"""The tables of the six reports, built from the canonical inputs.

Large tables that several report tables start from are written to the shared folder
once; small ones (a row per process, treatment or line) are cached for one report
only, and lost cache blocks are recomputed from their lineage. Reports that don't need
each other are made at once, as most of their tables leave executors idle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from careline.operators import cohort as C
from careline.operators import coverage as V
from careline.operators import dispensing as D
from careline.operators import dosing as O
from careline.operators import lines as N
from careline.operators import patients as P
from careline.operators import steps as S
from careline.operators import summary as M
from careline.operators import survival as K
from careline.operators import trend as R
from careline.session import written as shared_table
from careline.sources.sinks import Table, new_run, publish, write_report


#: Reports that are made at once.
AT_ONCE = 4


@contextmanager
def shared(frame: DataFrame) -> Iterator[DataFrame]:
    """Keep a frame while the tables built on it are written."""
    frame.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield frame
    finally:
        frame.unpersist()


def valid_by_patient(rows: DataFrame, prescriptions: DataFrame, as_of: str) -> DataFrame:
    """`dispensing.valid_dispensings`: short patients by patient, long ones and rows without id by time."""
    both = rows.select("nhc").unionByName(prescriptions.select("nhc"))
    long = P.long_patients(both, "nhc")
    (near, cut), (near_presc, cut_presc) = (P.split(x, long, "nhc") for x in (rows, prescriptions))
    return (P.valid_within(near.repartition("nhc"), near_presc.repartition("nhc"), as_of)
            .unionByName(D.valid_dispensings(cut, cut_presc, as_of)))


def coverage_by_patient(valid: DataFrame) -> DataFrame:
    """`coverage.coverage_ratio`: short patients are exchanged once."""
    short, cut = P.split(valid, P.long_patients(valid, "nhc"), "nhc")
    return (V.coverage_within(V.treatment_sums(short.repartition("nhc")))
            .unionByName(V.coverage_ratio(cut)))


def outcome_tables(steps: DataFrame, processes: DataFrame, as_of_year: int) -> dict[str, Table]:
    summary = M.outcome_summary(S.process_outcomes(S.clean(processes), steps))
    rollup = M.outcome_rollup(summary, as_of_year)
    return {
        "summary": Table(M.outcome_report(summary, as_of_year),
                         ["start_year", "drug_name", "indication_code"]),
        "chart": Table(M.outcome_long(rollup), ["start_year", "drug_name", "result_order"]),
        "steps": Table(S.step_frame(steps, S.with_best_change(processes, steps))),
    }


def trend_tables(steps: DataFrame, processes: DataFrame) -> dict[str, Table]:
    points = R.success_steps(S.clean(S.step_frame(steps, processes)))
    fit = R.trend_fit(points)
    return {
        "fit": Table(fit, ["drug_code"]),
        "coefficients": Table(R.with_p_value(R.trend_coefficients(fit)), ["drug_code", "term"]),
        "correlation": Table(R.with_p_value(R.trend_correlation(fit)), ["drug_code"]),
        "band": Table(R.trend_band(fit), ["drug_code", "month"]),
        "crossings": Table(R.threshold_crossing(fit), ["drug_code", "threshold"]),
        "points": Table(R.activity_points(points)),
    }


def adherence_tables(treatments: DataFrame) -> dict[str, Table]:
    """`treatments` as classified by `coverage.classified`."""
    return {
        "summary": Table(V.coverage_summary(treatments), ["med_group"]),
        "patients": Table(V.patients_total(treatments)),
        "by_drug": Table(V.coverage_summary_by_drug(treatments), ["med_group", "med_name"],
                         ("med_group",)),
        "chart": Table(V.coverage_by_group(treatments), ["med_group", "class_order"]),
        "chart_by_drug": Table(V.totals_by_drug(treatments),
                               ["med_group", "med_name", "class_order"]),
        "detail": Table(V.coverage_detail(treatments)),
    }


def persistence_tables(valid: DataFrame, patients: DataFrame, excluded_drug: str | None = None,
                       sex_levels=("F", "M"), more_than: int = 100) -> dict[str, Table]:
    people = shared_table(C.cohort_patients(valid, patients), "people")
    rows = C.cohort_rows(valid, people)
    ranked = K.frequent_drugs(C.patients_by_drug(people), more_than)
    counts = shared_table(K.ranked_counts(K.persistence_counts(rows), ranked), "counts")
    curve = K.kaplan_meier(counts.filter(F.col("position") <= 4))
    every_curve = K.kaplan_meier(counts)
    sexes = C.crosstab(people, "sex", sex_levels, excluded_drug)
    ages = C.crosstab(people, "age_band", list(C.AGE_COLUMNS), excluded_drug)
    return {
        "patients": Table(V.patients_total(C.naive_rows(valid))),
        "by_drug": Table(C.cohort_by_drug(people)),
        "by_drug_sex": Table(C.cohort_by_drug_sex(people, sex_levels)),
        "by_drug_age": Table(C.cohort_by_drug_age(people)),
        "chisq_drug": Table(C.with_p_value(C.chisq_goodness(people))),
        "chisq_sex": Table(C.with_p_value(C.chisq_independence(sexes))),
        "chisq_age": Table(C.with_p_value(C.chisq_independence(ages))),
        "curves": Table(curve, ["med_group", "months"]),
        "medians": Table(K.median_survival(curve), ["med_group"]),
        "all_curves": Table(every_curve, ["med_group", "months"]),
        "all_medians": Table(K.median_survival(every_curve), ["med_group"]),
        "logrank": Table(K.logrank_test(counts), ["comparison"]),
        "all_logrank": Table(K.logrank_test(counts, (), "all"), ["comparison"]),
    }


def path_tables(lines: DataFrame) -> dict[str, Table]:
    paths = N.treatment_paths(lines)
    return {
        "top_20": Table(N.top_paths(N.path_frequency(paths)), [F.desc("n"), "path"]),
        "flows": Table(N.line_flows(paths), [F.desc("n"), "first_drug", "second_drug"]),
        "all_paths": Table(N.path_duration_stats(paths), [F.desc("n"), "path", "position"]),
        "lines": Table(lines),
        "patients": Table(N.paths_by_position(paths)),
    }


def dosing_tables(rows: DataFrame, prescriptions: DataFrame, drug: str) -> dict[str, Table]:
    pairs = shared_table(O.key_pairs(rows, prescriptions), "pairs")
    per_patient = shared_table(O.patient_variants(
        O.dose_variant_order(O.dose_variants(rows, prescriptions, drug, pairs))), "variants")
    return {
        "combinations": Table(O.dose_combinations(per_patient),
                              [F.desc("patients"), "combination"]),
        "optimised_patients": Table(O.dose_variants_by_position(per_patient)),
        "all_patients": Table(O.dose_optimised(rows, prescriptions, drug, pairs)),
    }


def quality_tables(steps: DataFrame, processes: DataFrame, rows: DataFrame,
                   prescriptions: DataFrame, valid: DataFrame) -> dict[str, Table]:
    return {
        "start_in_remission": Table(S.start_in_remission(steps, processes)),
        "unmatched_dispensings": Table(D.unmatched_dispensings(rows, prescriptions)),
        "prescriptions": Table(D.prescription_extract(prescriptions)),
        "overlaps": Table(D.overlap_counts(valid)),
    }


def write_all_reports(inputs: dict[str, DataFrame], folder: str, as_of: str, drug: str,
                      excluded_drug: str | None = None, fmt: str = "parquet",
                      sex_levels=("F", "M")) -> list[tuple[str, str, str]]:
    """Write every report and publish them together; returns (report, table, path) per table.

    The tables go to a folder of this run; readers (`sinks.read_published`) see them when the last is there.
    `inputs` holds the canonical `steps`, `patients`, `dispensings`, `prescriptions`
    and, for the cohort and the lines, `cohort_dispensings` and
    `cohort_prescriptions` (the same tables unless the grain differs).
    """
    year, run = int(as_of[:4]), new_run(folder)
    spark = inputs["steps"].sparkSession

    def write(report: str, tables: dict[str, Table]) -> list[tuple[str, str, str]]:
        return [(report, name, path) for name, path in write_report(tables, f"{run}/{report}", fmt)]

    with ThreadPoolExecutor(AT_ONCE) as pool:
        def begin(work: Callable, *needed: Callable) -> Callable:
            """Start `work` on the results of what began before; returns how to wait for its own."""
            return pool.submit(inheritable_thread_target(spark)(
                lambda: work(*[wait() for wait in needed]))).result

        def adherence(valid: DataFrame):
            with shared(V.classified(coverage_by_patient(valid))) as treatments:
                return write("adherence", adherence_tables(treatments))

        def persistence():
            cohort_presc = D.with_posology(inputs.get("cohort_prescriptions", inputs["prescriptions"]))
            cohort_valid = shared_table(valid_by_patient(cohort_rows, cohort_presc, as_of), "valid")
            return write("persistence", persistence_tables(cohort_valid, inputs["patients"], excluded_drug,
                                                           sex_levels))

        def paths():
            with shared(N.treatment_lines(cohort_rows)) as lines:
                return write("paths", path_tables(lines))

        cohort_rows = D.dispensed(inputs.get("cohort_dispensings", inputs["dispensings"]))
        # in this order nobody waits long: what is needed begins first, then what needs nothing
        steps = begin(lambda: shared_table(inputs["steps"], "steps"))
        dispensings = begin(lambda: shared_table(inputs["dispensings"], "dispensings"))
        prescriptions = begin(lambda: shared_table(D.with_posology(inputs["prescriptions"]), "prescriptions"))
        persisting = begin(persistence)
        processes = begin(lambda x: shared_table(S.process_table(x), "processes"), steps)
        rows = begin(lambda x: shared_table(D.dispensing_gaps(x), "rows"), dispensings)
        valid = begin(lambda x, p: shared_table(valid_by_patient(D.dispensed(x), p, as_of), "valid"),
                      dispensings, prescriptions)
        parts = [
            begin(lambda x, p: write("outcome", outcome_tables(x, p, year)), steps, processes),
            begin(lambda x, p: write("trend", trend_tables(x, p)), steps, processes),
            begin(lambda *x: write("quality", quality_tables(*x)), steps, processes, rows, prescriptions, valid),
            begin(adherence, valid), persisting, begin(paths),
            begin(lambda r, p: write("dosing", dosing_tables(r, p, drug)), rows, prescriptions)]
        written = [line for part in parts for line in part()]
    publish(spark, folder, run, written, fmt)
    return written
