"""Delimited extracts and report sinks."""

import datetime as dt

from pyspark.sql import functions as F

from careline.sources import delimited as T
from careline.sources.sinks import Table, write_report, write_table


def write(path, text):
    path.write_text(text, encoding="utf-8")


def test_mangled_header():
    assert T.mangled(["NHC (sense ceros)", "Procés ID", "Procés.ID", "A-b"]) == [
        "NHC..sense.ceros.", "Procés.ID", "Procés.ID.1", "A.b"]


def test_steps_extract(spark, tmp_path):
    write(tmp_path / "one.csv",
          "NHC;NHC (sense ceros);Procés ID;Pas Alliberat Data;Valor Variable Codi;Pas Número dins el procés\n"
          "00012;12;7;2020-01-31 10:00:00;3,5;1\n"
          "00012;12;7;not a date;x;2\n")
    write(tmp_path / "two.csv",
          "NHC;NHC (sense ceros);Procés ID;Pas Alliberat Data;Valor Variable Codi;Pas Número dins el procés\n"
          "9;9;8;2020/02/01 00:00:05;;1\n")
    write(tmp_path / "ignored.txt", "NHC\nx\n")
    rows = {(r.nhc_raw, r.step_no): r for r in T.read_steps(spark, str(tmp_path)).collect()}
    assert len(rows) == 3
    first, bad, other = rows[("00012", 1)], rows[("00012", 2)], rows[("9", 1)]
    assert (first.score, first.process_id, first.nhc) == (3.5, 7, "12")
    assert first.step_ts == dt.datetime(2020, 1, 31, 10)
    assert (bad.score, bad.step_ts) == (None, None)
    assert other.score is None and other.step_ts == dt.datetime(2020, 2, 1, 0, 0, 5)


def test_prescriptions_extract(spark, tmp_path):
    write(tmp_path / "p.csv",
          "NHC (sense ceros);NHC;Prescripció ID;Medicament Codi;Especialitat Codi Nacional;"
          "Dosi Prescrita;Freqüència Tipus Codi;Freqüència Codi;Freqüència Descripció;"
          "Data Inici Prescripció;Data Fi Prescripció\n"
          "12;0012;a;M1;6543217;40,5;4;2SET;cada 2 setmanes;2020-01-01 00:00:00;\n"
          ";N/D;b;M1;6543217;1;4;SET;x;2020-01-01 00:00:00;\n"
          "1;;c;M1;6543217;1;4;SET;x;2020-01-01 00:00:00;\n")
    rows = T.read_prescriptions(spark, str(tmp_path)).collect()
    assert [(r.nhc, r.presc_national_code, r.dose, r.posology_days, r.valid_to) for r in rows] == [
        ("12", 654321, 40.5, 14.0, None)]


def test_pattern_typing(spark):
    raw = spark.createDataFrame([("7", "2020-01-01", "1,5", "t"), ("8", "2020-01-01T01:02:03Z", "1.5", "u")],
                                ["nhc", "MyDataX", "Valor.Variable.Y", "other"])
    got = T.typed_projection(raw)
    assert dict(got.dtypes) == {"nhc": "string", "MyDataX": "timestamp", "Valor.Variable.Y": "double",
                                "other": "string"}
    rows = sorted(got.collect(), key=lambda r: r.nhc)
    assert rows[0].MyDataX is None and rows[1].MyDataX == dt.datetime(2020, 1, 1, 1, 2, 3)
    assert [r["Valor.Variable.Y"] for r in rows] == [1.5, 1.5]


def test_report_directories(spark, tmp_path):
    frame = spark.createDataFrame([("b", 1), ("a", 2)], "g string, n int")
    done = dict(write_report({"summary": Table(frame, [F.desc("n")]), "parts": Table(frame, [], ("g",))},
                             str(tmp_path)))
    assert [tuple(r) for r in spark.read.parquet(done["summary"]).collect()] == [("a", 2), ("b", 1)]
    assert (tmp_path / "parts" / "by_g=a").is_dir()
    csv = dict(write_report({"summary": Table(frame, ["g"])}, str(tmp_path / "csv"), "csv"))
    assert spark.read.option("sep", ";").option("header", True).csv(csv["summary"]).count() == 2


def test_columns_go_by_name_over_files(spark, tmp_path):
    """Files in another order or without a column; `NA`, upper case, digits first, short years."""
    (tmp_path / "a.csv").write_text("Nhc;Medicament.AGRUPAT;Data.Consum;VALOR.VARIABLE.CODI;1r camp\n"
                                    "001;A;2001/02/03 04:05:06;1,5;x\n")
    (tmp_path / "b.csv").write_text("Medicament.AGRUPAT;Nhc;Data.Consum\n"
                                    "B;002;01/02/03 04:05:06\nNA;NA;99-1-2 3:4:5\n;\"003\";\n")
    frame = T.read_delimited(spark, str(tmp_path))
    assert "X1r.camp" in frame.columns
    got = {r["Nhc"]: r for r in T.typed_projection(frame).collect()}
    assert {k: r["Medicament.AGRUPAT"] for k, r in got.items()} == {
        "001": "A", "002": "B", None: None, "003": None}
    assert got["001"]["VALOR.VARIABLE.CODI"] == 1.5 and got["002"]["X1r.camp"] is None
    assert [str(got[k]["Data.Consum"]) for k in ("001", "002", None)] == [
        "2001-02-03 04:05:06", "2001-02-03 04:05:06", "1999-01-02 03:04:05"]
    ids = T.read_dispensings(spark, str(tmp_path))
    assert {r.nhc_raw for r in ids.collect()} == {"001", "002", "003"}


def test_partition_columns_keep_their_type(spark, tmp_path):
    frame = spark.createDataFrame([("007", 1), ("7", 2)], "med_group string, n int")
    write_table(Table(frame, ["n"], ("med_group",)), str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert dict(back.dtypes)["med_group"] == "string"
    assert {r.med_group for r in back.collect()} == {"007", "7"}


def test_layouts_of_times(spark):
    at = dt.datetime
    want = {"20200105103000": at(2020, 1, 5, 10, 30), "2020-01-05 10:30": None, "2020-01-05 1030": None,
            "20200105 103007.5": at(2020, 1, 5, 10, 30, 7, 500_000), "202001051030": None,
            "20200105T103000Z": at(2020, 1, 5, 10, 30), "2020-1-5 9:03:04": at(2020, 1, 5, 9, 3, 4),
            "2020-01-05T10:30:00+02:00": at(2020, 1, 5, 8, 30), "2020-01-05 10:30:00 -0130": at(2020, 1, 5, 12),
            "2020-01-05 10:30:00+01": at(2020, 1, 5, 9, 30), "20/01/05 10.30.00": at(2020, 1, 5, 10, 30),
            "70-01-05 10:30:00": at(1970, 1, 5, 10, 30), "2020-01-05 103000": at(2020, 1, 5, 10, 30),
            "20200105 10:30:00": at(2020, 1, 5, 10, 30), "2020-02-30 10:30:00": None, "20200105": None,
            "2020-01-05": None, "2020-01-05 25:00:00": None, "": None, "NA": None, "10:30:00": None,
            "2020-01-05 10:30:00 x": None, " 2020-01-05 10:30:00 ": at(2020, 1, 5, 10, 30), None: None}
    rows = spark.createDataFrame([(t,) for t in want], "t string").select("t", T.to_time(F.col("t")).alias("at"))
    assert {r.t: r["at"] for r in rows.collect()} == want


def test_a_run_that_stops_leaves_the_last_one_in_force(spark, tmp_path, monkeypatch):
    from careline.sources import sinks

    folder = str(tmp_path)

    def run(values, fail_at=None):
        made = []
        original = sinks.write_table

        def stopping(table, path, fmt="parquet"):
            if len(made) == fail_at:
                raise RuntimeError("stopped")
            original(table, path, fmt)
            made.append(path)
        monkeypatch.setattr(sinks, "write_table", stopping)
        try:
            place = sinks.new_run(folder)
            tables = {n: Table(spark.createDataFrame([(v,)], "x int")) for n, v in values.items()}
            written = [("r", n, p) for n, p in write_report(tables, f"{place}/r")]
            return sinks.publish(spark, folder, place, written)
        finally:
            monkeypatch.setattr(sinks, "write_table", original)

    def seen():
        return {n: df.first().x for (_, n), df in sinks.read_published(spark, folder).items()}

    assert seen() == {} and sinks.superseded(spark, folder) == []
    assert run({"a": 1, "b": 2}) == 1
    try:
        run({"a": 3, "b": 4}, fail_at=1)
        raise AssertionError("it should have stopped")
    except RuntimeError:
        pass
    assert seen() == {"a": 1, "b": 2}
    assert run({"a": 5, "b": 6}) == 2
    assert seen() == {"a": 5, "b": 6}
    old = sinks.superseded(spark, folder)
    assert len(old) == 1 and old[0].startswith(f"{folder}/runs/")


def test_fingerprints_see_swapped_values_and_texts_as_long(spark):
    from careline.plans.registry import fingerprint

    def of(rows):
        frame = spark.createDataFrame(rows, "med_group string, months double, at_risk bigint, events bigint, "
                                            "censored bigint, survival double")
        return frame.selectExpr(fingerprint("persistence", "curves")).first()[0]

    rows = [("A", 1.0, 5, 1, 0, 0.8), ("B", 2.0, 4, 2, None, 0.5)]
    assert of(rows) == of(rows[::-1]) == of([*rows[:1], ("B", 2.0, 4, 2, None, 0.50001)])
    assert of(rows) != of([("A", 1.0, 4, 1, 0, 0.8), ("B", 2.0, 5, 2, None, 0.5)])
    assert of(rows) != of([("C", 1.0, 5, 1, 0, 0.8), rows[1]])
    assert of(rows) != of([("A", 1.0, 5, 1, 0, 0.801), ("B", 2.0, 4, 2, None, 0.499)])
    assert of(rows) != of([rows[0], ("B", 2.0, 4, 2, 0, 0.5)])
    assert of([]) == 0


def test_both_engines_make_one_fingerprint(spark):
    import duckdb

    from careline.plans.registry import fingerprint
    from oracle.sql import HEX_NUMBER

    values = "('é|x', 1.0005, 2, 1, NULL, 0.25), (NULL, -3.5, 7, 0, 2, 1.0)"
    names = "t(med_group, months, at_risk, events, censored, survival)"
    here = spark.sql(f"SELECT {fingerprint('persistence', 'curves')} FROM VALUES {values} AS {names}").first()[0]
    there = duckdb.sql(f"SELECT {fingerprint('persistence', 'curves', HEX_NUMBER)} FROM (VALUES {values}) {names}")
    assert here == there.fetchall()[0][0]


def test_planning_a_scan_reads_beginnings_only(spark, tmp_path):
    line = "12;2020-01-31 10:00:00;" + "x" * 100 + "\n"
    for k in range(5):
        write(tmp_path / f"é {k}.csv", "Nhc;Data Consum;Medicament Codi\n" + line * 60_000)
    write(tmp_path / "empty.csv", "")
    size = sum(f.stat().st_size for f in tmp_path.iterdir())
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages(after):
        found = []
        for i in range(after, after + 1000):
            try:
                found.append(store.lastStageAttempt(i))
            except Exception:  # noqa: BLE001 - no such stage
                break
        return found

    first = next(i for i in range(100_000) if not stages(i))
    files = T._headers(spark, str(tmp_path))
    read = sum(s.inputBytes() for s in stages(first))
    assert sorted(map(len, files.values())) == [5]
    assert 0 < read < size / 20
    assert T.read_dispensings(spark, str(tmp_path)).count() == 300_000
