"""Persistence, tests on cross tables and regressions against closed forms."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from careline.operators import cohort as C
from careline.operators import survival as K
from careline.operators import trend as R

DAY0 = dt.datetime(2020, 1, 1)


def counts(spark, rows):
    return spark.createDataFrame(rows, "med_group string, months double, n bigint, d bigint")


def test_kaplan_meier_and_median(spark):
    curve = K.kaplan_meier(counts(spark, [("A", 1.0, 1, 1), ("A", 2.0, 2, 1), ("A", 3.0, 1, 1), ("A", 4.0, 1, 0)]))
    rows = curve.orderBy("months").collect()
    assert [round(r.survival, 6) for r in rows] == [0.8, 0.6, 0.3, 0.3]
    assert [r.at_risk for r in rows] == [5, 4, 2, 1]
    assert [r.cumulative_events for r in rows] == [1, 2, 3, 3]
    assert [r.censored for r in rows] == [0, 1, 0, 1]
    assert K.median_survival(curve).first().median_months == 3.0
    flat = K.kaplan_meier(counts(spark, [("A", 1.0, 2, 2), ("A", 5.0, 2, 1), ("B", 1.0, 9, 1)]))
    got = {r.med_group: r.median_months for r in K.median_survival(flat).collect()}
    assert got == {"A": 3.0, "B": None}


def naive_logrank(groups):
    """Two groups of (time, event) lists: statistic by the definition."""
    times = sorted({t for g in groups for t, _ in g})
    o = e = v = 0.0
    for t in times:
        n1, n = sum(x >= t for x, _ in groups[0]), sum(x >= t for g in groups for x, _ in g)
        d1 = sum(x == t and ev for x, ev in groups[0])
        d = sum(x == t and ev for g in groups for x, ev in g)
        o, e = o + d1, e + d * n1 / n
        if n > 1:
            v += d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1)
    return (o - e) ** 2 / v


def test_logrank(spark):
    a = [(1.0, 1), (2.0, 1), (2.0, 0), (5.0, 1), (7.0, 0)]
    b = [(2.0, 1), (3.0, 1), (6.0, 0), (8.0, 1)]
    rows = [(g, t, 1, ev) for g, group in (("A", a), ("B", b)) for t, ev in group]
    table = (counts(spark, rows).groupBy("med_group", "months")
             .agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
             .withColumn("position", F.when(F.col("med_group") == "A", 1).otherwise(2)))
    test = K.logrank_test(table, ((1, 2),)).first()
    assert test.chisq == pytest.approx(naive_logrank([a, b]))
    assert test.df == 1 and 0 < test.p_value < 1
    parts = K.logrank_observed_expected(table, ((1, 2),)).collect()
    assert sum(r.observed - r.expected for r in parts) == pytest.approx(0.0)


def test_logrank_leaves_absent_drugs_out(spark):
    table = counts(spark, [("A", 1.0, 2, 1), ("A", 3.0, 2, 2), ("B", 2.0, 2, 1), ("B", 4.0, 3, 1)])
    table = table.withColumn("position", F.when(F.col("med_group") == "A", 1).otherwise(2))
    got = {r.comparison: r for r in K.logrank_test(table).collect()}
    assert got["1_2_3_4"].chisq == pytest.approx(got["1_2"].chisq)
    assert (got["1_2_3_4"].df, got["1_2"].df, got["1_3"].df) == (1, 1, 0)
    assert got["1_3"].chisq is None and got["1_3"].p_value is None


def cohort(spark):
    days = {"p": [0, 0, 31, 60], "q": [5], "r": [1, 1, 1], "s": [0, 45]}
    rows = [(p, "A" if p in "pq" else "B", DAY0 + dt.timedelta(days=d), i)
            for p, ds in days.items() for i, d in enumerate(ds)]
    return spark.createDataFrame(rows, "nhc string, med_group string, dispensed_at timestamp_ntz, tie int")


@pytest.mark.parametrize("end", ["previous", "current"])
def test_counts_equal_row_level_times(spark, end):
    rows = cohort(spark)
    by_row = (K.persistence_times(rows, end).groupBy("med_group", "months")
              .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_last").cast("bigint")).alias("d")))
    by_count = K.persistence_counts(rows, end)
    assert sorted(map(tuple, by_row.collect())) == sorted(map(tuple, by_count.collect()))
    assert by_count.agg(F.sum("n"), F.sum("d")).first()[:] == (10, 4)


def test_patient_unit_and_options(spark):
    got = K.persistence_counts(cohort(spark), "current", "patient").agg(F.sum("n"), F.sum("d")).first()
    assert got[:] == (4, 4)
    with pytest.raises(ValueError):
        K.persistence_counts(cohort(spark), "someday")


def cells(spark, table):
    rows = [(d, l, n) for d, row in table.items() for l, n in row.items()]
    return spark.createDataFrame(rows, "med_group string, level string, n bigint")


def test_chi_square(spark):
    two = cells(spark, {"A": {"F": 10, "M": 20}, "B": {"F": 30, "M": 15}})
    got = C.chisq_independence(two).first()
    expected = 75 * (abs(10 * 15 - 20 * 30) - 75 / 2) ** 2 / (30 * 45 * 40 * 35)
    assert (got.chisq, got.df) == (pytest.approx(expected), 1)
    three = {"A": {"x": 10, "y": 0, "z": 0}, "B": {"x": 5, "y": 5, "z": 0}, "C": {"x": 5, "y": 15, "z": 0}}
    got = C.chisq_independence(cells(spark, three)).first()
    assert (got.chisq, got.df) == (pytest.approx(5 + 0 + 2.5 + 5 + 0 + 2.5), 2)
    assert math.isnan(C.chisq_independence(cells(spark, three), "keep").first().chisq)
    people = spark.createDataFrame([("A", 30), ("B", 10), ("C", 20)], "med_group string, n_rows bigint")
    got = C.with_p_value(C.chisq_goodness(people)).first()
    assert (got.chisq, got.df) == (pytest.approx(10.0), 2)
    assert got.p_value == pytest.approx(math.exp(-5.0))


def test_cohort_totals_add_rows_and_rounded_shares(spark):
    people = spark.createDataFrame(
        [(f"p{i}", g, s, "20-40 anys", 1) for i, (g, s) in enumerate(
            [("A", "F"), ("B", "M"), ("C", None)])],
        "nhc string, med_group string, sex string, age_band string, n_rows bigint")
    by_drug = {r.med_group: (r.patients, r.pct) for r in C.cohort_by_drug(people).collect()}
    assert by_drug["Totals"] == (3, 99.9) and by_drug["A"] == (1, 33.3)
    by_sex = {r.med_group: (r.n_f, r.n_m, r.n_unknown) for r in C.cohort_by_drug_sex(people).collect()}
    assert by_sex["Totals"] == (1, 1, 1) and by_sex["C"] == (0, 0, 1)
    ranked = K.frequent_drugs(C.patients_by_drug(people), 0).orderBy("position").collect()
    assert [r.med_group for r in ranked] == ["A", "B", "C"]


def test_trend_line_and_crossings(spark):
    rows = [("X", m, 6.0 - 0.5 * m + (0.1 if m % 2 else -0.1)) for m in range(13)]
    rows += [("UP", m, 3.0 + m) for m in range(4)] + [("LOW", m, 2.0 - 0.1 * m) for m in range(4)]
    steps = spark.createDataFrame(rows, "drug_code string, months_since_first int, score double")
    fit = R.trend_fit(steps)
    line = {r.drug_code: r for r in fit.collect()}
    assert line["UP"].slope == pytest.approx(1.0) and line["UP"].residual_sd == pytest.approx(0, abs=1e-7)
    x = line["X"]
    got = {r.threshold: (r.month, r.activity, r.label)
           for r in R.threshold_crossing(fit).collect() if r.drug_code == "X"}

    def before(threshold):
        return min(m for m in range(13) if x.intercept + x.slope * m < threshold) - 1

    assert got[3.1][0] == before(3.1) and got[2.5][0] == before(2.5)
    assert got[3.1][1:] == (None, "NA: 5mesos") or got[3.1][1] == "Activ.Baixa"
    # the rising line never falls below, the low one starts below
    assert {r.drug_code for r in R.threshold_crossing(fit).collect()} == {"X", "UP"} - {"UP"}
    inverse = {(r.drug_code, r.score): r for r in R.trend_inverse(fit).collect()}
    assert inverse[("UP", 5.0)].months_to_score == pytest.approx(2.0)
    assert inverse[("UP", 5.0)].line_value == 8.0
    band = [r for r in R.trend_band(fit).collect() if r.drug_code == "X" and r.month == 6]
    half = 2.200985160082949 * x.residual_sd / math.sqrt(13)
    assert band[0].high - band[0].predicted == pytest.approx(half, abs=1e-9)
    test = {r.drug_code: r for r in R.with_p_value(R.trend_correlation(fit)).collect()}["X"]
    assert test.df == 11 and test.p_value < 1e-9 and test.low < test.r < test.high


def test_logrank_of_any_number_of_drugs(spark):
    """Seven drugs, of which one has no rows at most times, against the definition time by time."""
    import random

    import numpy as np

    rng = random.Random(5)
    rows = {}
    for g in range(7):
        for _ in range(1 if g == 6 else 40):
            key = (f"D{g}", float(rng.randrange(12)))
            n, d = rows.get(key, (0, 0))
            rows[key] = (n + 2, d + rng.randrange(3))
    table = counts(spark, [(*k, *v) for k, v in rows.items()]).withColumn(
        "position", F.substring("med_group", 2, 1).cast("int") + 1)
    z, v = np.zeros(7), np.zeros((7, 7))
    for t in sorted({t for _, t in rows}):
        r = np.array([sum(n for (g, x), (n, _) in rows.items() if g == f"D{k}" and x >= t) for k in range(7)])
        d = np.array([rows.get((f"D{k}", t), (0, 0))[1] for k in range(7)])
        share = r / r.sum()
        z += d - d.sum() * share
        if r.sum() > 1:
            v += d.sum() * (r.sum() - d.sum()) / (r.sum() - 1) * (np.diag(share) - np.outer(share, share))
    test = K.logrank_test(table, ((2, 5),), "all").collect()
    whole = next(r for r in test if r.comparison == "all")
    assert whole.df == 6 and whole.chisq == pytest.approx(z[:6] @ np.linalg.solve(v[:6, :6], z[:6]))
    pair = next(r for r in test if r.comparison == "2_5")
    groups = [[(t, e) for (g, t), (n, d) in rows.items() if g == name for e in [1] * d + [0] * (n - d)]
              for name in ("D1", "D4")]
    assert pair.df == 1 and pair.chisq == pytest.approx(naive_logrank(groups))
    cells = {(r.p, r.q): r.covariance for r in K.logrank_covariance(table, (), "all").collect()}
    assert len(cells) == 28
    assert all(cells[p, q] == pytest.approx(v[p - 1, q - 1]) for p, q in cells)
    parts = K.logrank_observed_expected(table, (), "all").collect()
    assert {r.med_group: r.observed - r.expected for r in parts} == {
        f"D{k}": pytest.approx(z[k], abs=1e-9) for k in range(7)}


def test_logrank_of_no_drug(spark):
    table = counts(spark, []).withColumn("position", F.lit(1))
    assert K.logrank_test(table, (), "all").collect() == []


def test_coefficient_table_and_exact_moments(spark):
    """A textbook line with its errors, points without a value, and drugs with too few points."""
    points = [("a", m, s) for m, s in [(0, 5.0), (1, 4.4), (2, 4.1), (4, 2.9), (7, 2.2)]]
    points += [("a", None, 9.0), ("a", 3, None), ("b", 1, 2.5), ("b", 2, 2.0), ("c", 3, 1.0), ("c", 3, 2.0),
               ("c", 3, 3.0), ("d", 1, None)]
    frame = spark.createDataFrame(points, "drug_code string, months_since_first int, score double")
    got = {(r.drug_code, r.term): r for r in R.with_p_value(R.trend_coefficients(R.trend_fit(frame))).collect()}
    x, y = [0, 1, 2, 4, 7], [5.0, 4.4, 4.1, 2.9, 2.2]
    mx, my = sum(x) / 5, sum(y) / 5
    qx = sum((a - mx) ** 2 for a in x)
    slope = sum((a - mx) * (b - my) for a, b in zip(x, y)) / qx
    level = my - slope * mx
    sd = math.sqrt(sum((b - level - slope * a) ** 2 for a, b in zip(x, y)) / 3)
    want = {"months": (slope, sd / math.sqrt(qx)), "intercept": (level, sd * math.sqrt(1 / 5 + mx * mx / qx))}
    for term, (estimate, error) in want.items():
        r = got["a", term]
        assert (r.n, r.df) == (5, 3)
        assert (r.estimate, r.std_error, r.t) == pytest.approx((estimate, error, estimate / error))
        assert 0 < r.p_value < 0.05
    assert got["b", "months"].estimate == pytest.approx(-0.5) and got["b", "months"].p_value is None
    assert got["c", "months"].estimate is None and got["c", "months"].std_error is None
    assert got["d", "months"].n == 0 and got["d", "months"].estimate is None
    sums = {r.drug_code: r for r in R.trend_moments(frame).collect()}
    assert (sums["a"].n, sums["a"].x, int(sums["a"].y), int(sums["a"].xy)) == (
        5, 14, 186_000, sum(int(a * round(b * 10_000)) for a, b in zip(x, y)))
    # the same bits, whatever the order of the rows
    many = [("a", i % 40, round(10 - (i * 37 % 101) / 11, 4)) for i in range(5000)]
    fits = [R.trend_fit(spark.createDataFrame(rows, frame.schema).repartition(n)).first()
            for rows, n in ((many, 3), (many[::-1], 7))]
    assert fits[0] == fits[1]
