"""Shared expressions: missing values, time, rounding, bands, posology, tails."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from careline.functions import labels as L
from careline.functions import tails
from careline.functions.bands import activity_band, age_band, coverage_class
from careline.functions.posology import posology_days
from careline.functions.rounding import mean_of_tenths, round_to, round_up_to
from careline.functions.semantics import join_on, single_valued, strict
from careline.functions.text import (drop_last_character, integer_of, number_text, percent_text,
                                     strip_zeros)
from careline.functions.timeparts import elapsed_days, elapsed_weeks, months_between, whole_months


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


def test_strict(spark):
    rows = spark.createDataFrame(
        [("a", 1), ("a", None), ("b", 2), ("b", 3), ("d", None)], "g string, x int")
    got = {r.g: r.s for r in rows.groupBy("g").agg(strict(F.sum("x"), "x").alias("s")).collect()}
    assert got == {"a": None, "b": 5, "d": None}


def test_single_valued_counts_missing_as_value(spark):
    rows = spark.createDataFrame(
        [("a", "x", 1), ("a", "x", 1), ("b", "x", 1), ("b", None, 1), ("c", None, None),
         ("c", None, None), ("d", "x", 1), ("d", "x", None), ("e", "x", 1), ("e", "y", 1)],
        "g string, m string, n int")
    got = {r.g: (r.m, r.mn) for r in rows.groupBy("g").agg(
        single_valued("m").alias("m"), single_valued("m", "n").alias("mn")).collect()}
    assert got == {"a": (True, True), "b": (False, False), "c": (True, True),
                   "d": (True, False), "e": (False, False)}


def test_missing_keys_match(spark):
    left = spark.createDataFrame([("p", None, 1), ("q", "a", 2)], "nhc string, code string, l int")
    right = spark.createDataFrame([("p", None, 5), ("q", "b", 6)], "nhc string, code string, r int")
    got = sorted(join_on(left, right, ["nhc", "code"], "left").collect(), key=lambda r: r.l)
    assert [r.r for r in got] == [5, None]


@pytest.mark.parametrize("a, b, whole", [
    ("2020-01-31 00:00:00", "2020-02-29 00:00:00", 1),
    ("2019-12-15 12:00:00", "2020-01-15 10:00:00", 0),
    ("2020-01-10 00:00:00", "2020-01-10 00:00:00", 0),
    ("2020-01-01 00:00:00", "2021-03-01 00:00:00", 14),
    ("2020-03-01 00:00:00", "2020-01-15 00:00:00", -2),
    ("2020-02-15 00:00:00", "2020-01-15 00:00:00", -1),
])
def test_whole_months(spark, a, b, whole):
    assert one(spark, whole_months(ts(a), ts(b))) == whole
    assert math.floor(one(spark, months_between(ts(a), ts(b)))) == whole


def test_month_fraction(spark):
    got = one(spark, months_between(ts("2020-01-01 00:00:00"), ts("2020-02-15 12:00:00")))
    assert got == pytest.approx(1 + 14.5 / 29)
    assert one(spark, months_between(ts("2020-01-01 00:00:00"), F.lit(None).cast("timestamp_ntz"))) is None


def test_elapsed_days_and_weeks(spark):
    a, b = ts("2020-01-01 12:00:00"), ts("2020-01-03 10:00:00")
    assert one(spark, elapsed_days(a, b)) == 1
    assert one(spark, elapsed_days(b, a)) == -2
    assert one(spark, elapsed_weeks(a, ts("2020-01-15 11:00:00"))) == 1


def test_rounding(spark):
    assert one(spark, round_to(F.lit(0.25), 1)) == 0.3
    assert one(spark, round_to(F.lit(0.25), 1, "half_even")) == 0.2
    assert one(spark, round_to(F.lit(-0.25), 1)) == -0.3
    assert one(spark, round_up_to(F.lit(41), 10)) == 50
    assert one(spark, mean_of_tenths(F.lit(17), F.lit(2))) == 0.9


def test_text(spark):
    assert one(spark, percent_text(F.lit(50.0))) == "50%"
    assert one(spark, percent_text(F.lit(33.3))) == "33.3%"
    assert one(spark, percent_text(F.lit(None).cast("double"))) == "NA%"
    assert one(spark, number_text(F.lit(10))) == "10"
    assert one(spark, strip_zeros(F.lit("000120"))) == "120"
    assert one(spark, integer_of(drop_last_character(F.lit("1234567")))) == 123456
    assert one(spark, integer_of(F.lit("12.7"))) == 12
    assert one(spark, integer_of(F.lit("x"))) is None


@pytest.mark.parametrize("score, label", [
    (2.59, L.REMISSION), (2.6, L.ACTIVITY_LOW), (3.2, L.ACTIVITY_LOW), (3.21, L.ACTIVITY_MODERATE),
    (5.1, L.ACTIVITY_MODERATE), (10.0, L.ACTIVITY_HIGH), (10.1, None)])
def test_activity(spark, score, label):
    assert one(spark, activity_band(F.lit(score))) == label
    assert one(spark, activity_band(F.lit(score), None)) == (label or L.ACTIVITY_HIGH)


def test_coverage_and_age_bands(spark):
    got = [one(spark, coverage_class(F.lit(c), F.lit(d)))
           for c, d in ((1.5, 1), (0.9, 9), (0.8, 9), (0.5, 9), (0.4, 9))]
    assert got == [L.COVERAGE_SINGLE, ">=0.9", "0.8-0.9", "0.5-0.8", "<0.5"]
    ages = [one(spark, age_band(F.lit(a).cast("int"))) for a in (19, 20, 40, 41, 60, 61, 80, 81, None)]
    assert ages == [L.AGE_LEVELS[i] for i in (0, 1, 1, 2, 3, 4, 5, 6, 7)]


@pytest.mark.parametrize("kind, code, desc, value", [
    ("1", "12MES", "", 30.0), ("1", "MES", "", None), ("4", "SET", "", 7.0), ("4", "2SET", "", 14.0),
    ("4", "3DT", "", 3.0), ("4", "2D", "", 2.0), ("4", "6M", "", 0.25), ("4", "15", "", 15.0),
    ("7", "ANY", None, 1.0), ("5", "H", "c/8h", 0.33), ("5", "DO", "", 7.0), ("5", "A12", "", 1.0),
    ("5", "ES", "", 1.0), ("5", "EDS", "", 0.3), ("5", "1-0-1", "", 0.5),
    ("5", "2SET", "2 cops", 3.5), ("6", "8H", "cada 8 hores", 3.0), ("0", "1 DOSIS", "", 1.0),
    ("9", "PRN", "si cal", None), (None, "SET", "", None), ("4", None, "", None),
    ("6", "8H", "cada 0 hores", math.inf)])
def test_posology(spark, kind, code, desc, value):
    got = one(spark, posology_days(*[F.lit(v).cast("string") for v in (kind, code, desc)]))
    assert got == value


def test_tails():
    assert tails.chisq_upper(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert tails.chisq_upper(7.814727903251178, 3) == pytest.approx(0.05, abs=1e-10)
    assert tails.chisq_upper(500.0, 3) < 1e-90
    assert tails.student_two_sided(2.228138851964939, 10) == pytest.approx(0.05, abs=1e-10)
    assert tails.student_quantile(0.975, 10) == pytest.approx(2.228138851964939, abs=1e-9)
    assert tails.student_quantile(0.975, 1) == pytest.approx(12.706204736, abs=1e-6)
    assert tails.chisq_upper(None, 1) is None and tails.student_two_sided(1.0, 0) is None


def test_date_type_is_accepted(spark):
    assert one(spark, elapsed_days(F.lit(dt.date(2020, 1, 1)), F.lit(dt.date(2020, 1, 4)))) == 3
