"""Short patients by patient, long ones by time: the same rows, few exchanges."""

from collections import Counter

import pytest

import __spark_entry__ as contract
from conftest import TESTDATA
from oracle.check import compare, connect
from careline.operators import cohort as C
from careline.operators import coverage as V
from careline.operators import dispensing as D
from careline.operators import patients as P
from careline.operators import survival as K
from careline.plans.registry import AS_OF, CHECKED, Star


@pytest.mark.parametrize("folder", ["sf0.001"])
@pytest.mark.parametrize("name", ["coverage_ratio", "coverage_detail", "persistence_counts"])
@pytest.mark.parametrize("longest", [0, 20])
def test_long_and_short_patients(spark, monkeypatch, folder, name, longest):
    """Also with a border that some patients pass, so that both ways have rows."""
    monkeypatch.setattr(P.long_patients, "__defaults__", (longest,))
    path = str(TESTDATA / folder)
    problems, _ = compare(contract.queries()[name](spark, path), contract.oracle_sql()[name], connect(path))
    assert problems == []


def test_a_patient_s_rows_are_exchanged_once(spark):
    star = Star(spark, str(TESTDATA / "sf0.01"))
    (rows, presc), _ = star.by_patient(star.lines())
    frame = V.coverage_within(V.treatment_sums(P.valid_within(rows, presc, AS_OF)))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_missing_codes_and_ends(spark):
    rows = spark.createDataFrame(
        [("a", None, "2001-01-01"), ("a", "m", "2001-01-01"), ("a", "m", "2001-01-01"), ("a", "m", None),
         ("a", "m", "2002-02-01"), ("b", "m", "2001-01-01")], "nhc string, med_code string, t string")
    rows = rows.selectExpr("nhc", "med_code", "CAST(t AS TIMESTAMP_NTZ) AS dispensed_at")
    presc = spark.createDataFrame(
        [("a", None, "p", "2000-01-01", None), ("a", "m", "q", "2001-01-01", "2001-01-01"),
         ("a", "m", None, "2000-01-01", None), ("a", "m", "r", "2000-01-01", None),
         ("c", "m", "s", "2000-01-01", None)],
        "nhc string, med_code string, prescription_id string, f string, u string").selectExpr(
        "nhc", "med_code", "prescription_id", "'x' AS freq_desc", "1.0D AS posology_days",
        "CAST(f AS TIMESTAMP_NTZ) AS valid_from", "CAST(u AS TIMESTAMP_NTZ) AS valid_to")
    got = P.valid_within(rows, presc, "2001-12-31")
    want = D.valid_dispensings(rows, presc, "2001-12-31")
    assert got.columns == want.columns and got.count() == 3
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["paired_histories", "paired_histories_expanded", "point_in_time_posology"])
@pytest.mark.parametrize("longest", [20, 500])
def test_histories_and_posology(spark, monkeypatch, name, longest):
    monkeypatch.setattr(P.long_patients, "__defaults__", (longest,))
    path = str(TESTDATA / "sf0.001")
    problems, rows = compare(contract.queries()[name](spark, path), contract.oracle_sql()[name], connect(path))
    assert problems == [] and rows > 0


def test_pieces_without_partners(spark):
    """Large keys on one side only, and a small side that lies in a piece without the other."""
    rows = spark.createDataFrame([("a", "m", i) for i in range(30)] + [("b", "m", 1), ("d", "m", 2)],
                                 "nhc string, med_code string, qty int")
    presc = spark.createDataFrame([("a", "m", "p", 1)] + [(k, "m", f"q{i}", i) for k in "bc" for i in range(30)],
                                  "nhc string, med_code string, prescription_id string, dose int")
    want = Counter(map(tuple, D.dispensing_prescriptions(rows, presc).collect()))
    for piece in (3, 10, 1000):
        found = D.paired_histories(rows, presc, piece)
        assert {r.nhc for r in found.collect()} == {"a", "b", "d"}
        assert Counter(map(tuple, D.expanded_pairs(found).collect())) == want
    within = D.expanded_within(D.paired_histories(rows, presc, None))
    assert Counter(map(tuple, within.collect())) == want


def test_expanding_short_patients_takes_one_exchange_a_side(spark):
    star = Star(spark, str(TESTDATA / "sf0.01"))
    plan = D.expanded_within(star.histories[0])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") <= 3


@pytest.mark.parametrize("longest", [20, 500])
def test_by_code(spark, monkeypatch, longest):
    monkeypatch.setattr(P.long_patients, "__defaults__", (longest,))
    path = str(TESTDATA / "sf0.001")
    problems, rows = compare(contract.queries()["interval_join_by_code"](spark, path),
                             contract.oracle_sql()["interval_join_by_code"], connect(path))
    assert problems == [] and rows > 0


def test_ids_equal_as_numbers(spark):
    """`07` and `7` share the prescriptions of both, each by its own known drug; a code may be missing."""
    rows = spark.createDataFrame([("7", "m", 1), ("07", "m", 1), ("7", "n", None), ("8", "m", 1)],
                                 "nhc string, med_code string, national_code int").selectExpr(
        "*", "TIMESTAMP_NTZ '2001-01-01' AS dispensed_at")
    presc = spark.createDataFrame([("7", "m", "p", 1), ("07", "m", "q", 1), ("7", "n", "r", None), ("8", "m", None, 1)],
                                  "nhc string, med_code string, prescription_id string, presc_national_code int")
    presc = presc.selectExpr("*", "2.0D AS posology_days", "TIMESTAMP_NTZ '2000-01-01' AS valid_from",
                             "CAST(NULL AS TIMESTAMP_NTZ) AS valid_to")
    got, want = (f(rows, presc, "2001-12-31") for f in (P.by_code_within, D.interval_join_by_code))
    assert got.columns == want.columns and got.count() == 5
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_reports_read_their_inputs_once(spark, tmp_path):
    """Ten tables start from the steps; the join that makes them is run for one of them only."""
    from careline.plans import reports
    seen = []
    plain = reports.shared_table
    try:
        reports.shared_table = lambda frame, name: (seen.append(name), plain(frame, name))[1]
        contract.queries()["report_sinks"](spark, str(TESTDATA / "sf0.001"))
    finally:
        reports.shared_table = plain
    assert {"steps", "rows", "prescriptions", "people"} <= set(seen)


def test_reports_share_what_they_start_from(spark, monkeypatch):
    """Dispensings, processes, drugs with doses and variants are made once; reports are made in several threads."""
    import threading
    from careline.plans import reports
    seen, threads, table, save = [], set(), reports.shared_table, reports.write_report
    monkeypatch.setattr(reports, "shared_table", lambda frame, name: (seen.append(name), table(frame, name))[1])
    monkeypatch.setattr(reports, "write_report", lambda *a: (threads.add(threading.get_ident()), save(*a))[1])
    rows = contract.queries()["report_sinks"](spark, str(TESTDATA / "sf0.001"))
    once = {"steps", "dispensings", "prescriptions", "rows", "processes", "pairs", "variants"}
    assert all(seen.count(name) == 1 for name in once) and seen.count("valid") == 2 and len(threads) > 1
    problems, n = compare(rows, contract.oracle_sql()["report_sinks"], connect(str(TESTDATA / "sf0.001")))
    assert problems == [] and n == len(CHECKED)


def test_a_report_that_fails_ends_the_run(spark, monkeypatch, tmp_path):
    """Nothing is published, and the error is that of the report."""
    from careline.plans import reports
    from careline.sources.sinks import manifests
    def broken(*args):
        raise ValueError("no lines")
    monkeypatch.setattr(reports.N, "treatment_lines", broken)
    star = Star(spark, str(TESTDATA / "sf0.001"))
    inputs = {n: star.table(n) for n in ("steps", "patients", "dispensings", "prescriptions")}
    with pytest.raises(ValueError, match="no lines"):
        reports.write_all_reports(inputs, str(tmp_path), AS_OF, "ECONOMY")
    assert manifests(spark, str(tmp_path)).count() == 0


def test_valid_rows_and_coverage_by_patient(spark, monkeypatch):
    """As the operators give them, also with patients of both kinds and rows without id."""
    from careline.plans import reports
    from careline.functions.semantics import is_in
    from pyspark.sql import functions as F
    star = Star(spark, str(TESTDATA / "sf0.001"))
    lost = F.when(~is_in(F.col("nhc"), ("1", "2", "4", "5")), F.col("nhc"))
    rows, presc = (x.withColumn("nhc", lost) for x in (star.dispensed, star.prescriptions))
    want = D.valid_dispensings(rows, presc, AS_OF)
    rated = V.coverage_ratio(want)
    assert want.filter("nhc IS NULL").count() > 0
    for longest in (20, 500):
        monkeypatch.setattr(P.long_patients, "__defaults__", (longest,))
        got = reports.valid_by_patient(rows, presc, AS_OF)
        assert got.columns == want.columns
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
        found = reports.coverage_by_patient(want).select(*rated.columns)
        assert Counter(map(tuple, found.collect())) == Counter(map(tuple, rated.collect()))


def test_split_reads_rows_without_id_by_their_filter(spark, tmp_path):
    """Rows without id don't come out of a join of all rows with the long patients."""
    spark.createDataFrame([(str(i % 7), i) for i in range(50)] + [(None, 50), (None, 51)],
                          "nhc string, v int").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    for longest, ids in ((500, set()), (7, {"0"})):
        short, cut = P.split(rows, P.long_patients(rows, "nhc", longest), "nhc")
        plan = cut._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [IsNull(nhc)]" in plan and "LeftOuter" not in plan
        assert {r.nhc for r in cut.collect()} == ids | {None}
        assert Counter(map(tuple, short.union(cut).collect())) == Counter(map(tuple, rows.collect()))


PAIRS = ["dispensing_prescription_join", "matched_dispensings", "valid_dispensings", "qc_overlaps"]


@pytest.mark.parametrize("name", PAIRS)
@pytest.mark.parametrize("longest", [0, 20])
def test_pairs_and_valid_rows(spark, monkeypatch, name, longest):
    monkeypatch.setattr(P.long_patients, "__defaults__", (longest,))
    path = str(TESTDATA / "sf0.001")
    problems, rows = compare(contract.queries()[name](spark, path), contract.oracle_sql()[name], connect(path))
    assert problems == [] and rows > 0


def test_pairs_within_patients(spark):
    """Rows that are there twice, codes and prescription ids that are missing, rows without partner."""
    rows = spark.createDataFrame([("a", "m", 1), ("a", "m", 1), ("a", None, 2), ("a", "n", 3), ("b", "m", 4)],
                                 "nhc string, med_code string, qty int")
    presc = spark.createDataFrame([("a", "m", "p", 1), ("a", "m", None, 1), ("a", None, "q", 2), ("c", "m", "r", 1)],
                                  "nhc string, med_code string, prescription_id string, dose int")
    for how, operator, n in (("left", D.dispensing_prescriptions, 7), ("inner", D.matched_dispensings, 3)):
        got, want = P.pairs_within(rows, presc, how), operator(rows, presc)
        assert got.columns == want.columns and got.count() == n
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


@pytest.mark.parametrize("name", PAIRS)
def test_pairs_and_valid_rows_take_one_exchange_a_side(spark, monkeypatch, name):
    """Where there are only short patients; the line items with their orders and parts are written before."""
    monkeypatch.setattr(P, "split", lambda rows, long, key: (rows.filter(f"{key} IS NOT NULL"), rows.limit(0)))
    plan = contract.queries()[name](spark, str(TESTDATA / "sf0.01"))._jdf.queryExecution().optimizedPlan()
    sources = [x for x in plan.toString().splitlines() if "Relation" in x]
    assert sources and not [x for x in sources if "o_orderkey" in x or "p_partkey" in x]
    physical = contract.queries()[name](spark, str(TESTDATA / "sf0.01"))._jdf.queryExecution().executedPlan()
    assert physical.toString().count("Exchange hashpartitioning") == 2


def test_overlaps_of_parts(spark):
    """Parts that share no dispensing count like one table; an empty one adds nothing."""
    valid = spark.createDataFrame([("a", "m", 1), ("a", "m", 1), ("a", "n", 1), ("b", "m", 1), ("b", "m", 1),
                                   ("b", "m", 1)], "nhc string, med_code string, qty int")
    parts = valid.filter("nhc = 'a'"), valid.filter("nhc = 'b'"), valid.filter("nhc = 'c'")
    assert D.overlap_counts(*parts).collect() == D.overlap_counts(valid).collect() == [(3, 2, 3)]


def _instants(spark):
    """Patients with one instant, several, a missing one, two drugs, a missing drug and none at all."""
    rows = [("a", "g", "2001-01-01", 2), ("a", "g", "2001-03-05", 1), ("a", "g", "2001-03-09", 3),
            ("b", "g", "2001-01-01", 1), ("c", "g", "2001-01-01", 1), ("c", "h", "2001-02-01", 1),
            ("d", None, "2001-01-01", 1), ("d", None, "2001-05-01", 2), ("e", "h", "2001-01-01", 1),
            ("e", "h", None, 2), ("f", "g", "2001-01-01", 1), ("f", None, "2001-01-01", 1)]
    return spark.createDataFrame(rows, "nhc string, med_group string, t string, copies long").selectExpr(
        "nhc", "med_group", "CAST(t AS TIMESTAMP_NTZ) AS dispensed_at", "copies")


def test_naive_instants_and_their_ends_within_a_patient(spark):
    """Also with two records of a patient, which count twice, and a patient without record."""
    instants = _instants(spark)
    want = C.naive_rows(instants)
    naive = P.naive_within(instants)
    assert naive.columns == want.columns and {r.nhc for r in naive.collect()} == {"a", "b", "d", "e"}
    assert Counter(map(tuple, naive.collect())) == Counter(map(tuple, want.collect()))
    patients = spark.createDataFrame([("a", "F", 1950), ("a", "M", 1950), ("b", "F", None), ("d", "F", 1980)],
                                     "nhc string, sex string, birth_year int")
    people = C.cohort_patients(naive, patients, "copies")
    rows = P.cohort_within(naive, people)
    assert Counter(map(tuple, rows.collect())) == Counter(map(tuple, C.cohort_rows(naive, people).collect()))
    for unit in ("row", "patient"):
        for end in ("previous", "current"):
            within = K.persistence_counts(rows, end, unit, "copies", P.ends_within)
            across = K.persistence_counts(C.cohort_rows(instants, people), end, unit, "copies")
            assert Counter(map(tuple, within.collect())) == Counter(map(tuple, across.collect()))


def test_instants_and_curves_exchange_little(spark):
    """Only naive patients are written; curves exchange them and the people once, and cut no slices."""
    star = Star(spark, str(TESTDATA / "sf0.001"))
    short, _ = star.instant_parts
    assert short.count() == C.naive_rows(short).count() > 0
    counts = K.persistence_counts(P.cohort_within(short, star.people), copies="copies", ends=P.ends_within)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and "rangepartitioning" not in plan
