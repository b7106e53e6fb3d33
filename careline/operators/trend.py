"""Score over months since the start of treatment, one regression per drug.

Every figure follows from a few sums per drug, computed in one aggregation over
the steps of successful processes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careline.functions import labels as L
from careline.functions.bands import activity_band
from careline.functions.rounding import round_to
from careline.functions.semantics import join_on
from careline.functions.tails import student_p_value, student_quantile_975
from careline.functions.text import or_na

DRUG = ["drug_code"]
# Scores are added up as whole numbers of these parts of one.
SCORE_UNITS = 10_000
# Standard normal quantile of 0.975
NORMAL_975 = 1.959963984540054


def success_steps(clean_steps: DataFrame) -> DataFrame:
    """Steps of successful processes of the clean cohort, with the activity band."""
    return clean_steps.filter(F.col("result") == L.SUCCESS)


def trend_moments(steps: DataFrame) -> DataFrame:
    """Exact sums per drug over the steps with both values, in whole numbers.

    Scores count in ten-thousandths, so that sums, and what follows from them, don't depend on the
    order in which rows are added up.
    """
    x = F.col("months_since_first").cast("decimal(10,0)")
    y = F.round(F.col("score") * SCORE_UNITS).cast("decimal(18,0)")
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("decimal(38,0)")
    return steps.groupBy(*DRUG).agg(
        F.count(x).alias("n"), total(x).alias("x"), total(y).alias("y"), total(x * x).alias("xx"),
        total(x * y).alias("xy"), total(y * y).alias("yy"),
        F.max("months_since_first").alias("max_months"))


def trend_fit(steps: DataFrame) -> DataFrame:
    """Line score ~ months per drug: coefficients, fit and the sums behind them."""
    n = F.col("n").cast("decimal(19,0)")
    # n times the sums of squares and products around the means, still whole numbers
    spread = {name: (n * F.col(name) - F.col(name[0]) * F.col(name[1])).cast("double")
              for name in ("xx", "xy", "yy")}
    sums = trend_moments(steps).withColumns({f"__{k}": v for k, v in spread.items()})
    xx, xy, yy, n = F.col("__xx"), F.col("__xy"), F.col("__yy"), F.col("n").cast("double")
    y_mean = F.try_divide(F.col("y").cast("double"), n)
    x_mean = F.try_divide(F.col("x").cast("double"), n)
    slope = F.try_divide(xy, xx)
    intercept = y_mean - slope * x_mean
    r = F.try_divide(xy, F.sqrt(xx) * F.sqrt(yy))
    rest = yy - F.try_divide(xy * xy, xx)
    return sums.select(
        *DRUG, "n", x_mean.alias("mean_months"), (slope / SCORE_UNITS).alias("slope"),
        (intercept / SCORE_UNITS).alias("intercept"),
        F.when((xx > 0) & (yy == 0), 1.0).otherwise(F.try_divide(xy * xy, xx * yy)).alias("r_squared"),
        F.try_divide(xx, n).alias("sxx"), F.try_divide(yy, n * SCORE_UNITS ** 2).alias("syy"),
        F.try_divide(xy, n * SCORE_UNITS).alias("sxy"), r.alias("r"), "max_months",
        F.when(F.col("n") > 2, F.sqrt(F.greatest(rest, F.lit(0.0)) / (n * (n - 2))) / SCORE_UNITS)
        .alias("residual_sd"))


def trend_coefficients(fit: DataFrame) -> DataFrame:
    """Coefficient table of each regression: estimate, standard error, t and degrees of freedom.

    Two rows a drug. With fewer than three points or all at one month there is no error and no t.
    """
    sd, sxx, mean = F.col("residual_sd"), F.col("sxx"), F.col("mean_months")
    slope_error = F.try_divide(sd, F.sqrt(sxx))
    level_error = sd * F.sqrt(F.try_divide(F.lit(1.0), F.col("n")) + F.try_divide(mean * mean, sxx))
    terms = F.array(F.struct(F.lit("intercept").alias("term"), F.col("intercept").alias("estimate"),
                             level_error.alias("std_error")),
                    F.struct(F.lit("months").alias("term"), F.col("slope").alias("estimate"),
                             slope_error.alias("std_error")))
    df = F.when(F.col("n") > 2, F.col("n") - 2)
    return (fit.select(*DRUG, "n", df.alias("df"), F.explode(terms).alias("x"))
            .select(*DRUG, "n", "df", "x.*")
            .withColumn("t", F.try_divide("estimate", "std_error")))


def trend_correlation(fit: DataFrame) -> DataFrame:
    """Pearson correlation test per drug with at least three points."""
    r, n = F.col("r"), F.col("n")
    z, width = F.atanh(r), F.lit(NORMAL_975) / F.sqrt(n - 3)
    wide_enough = n > 3
    return (fit.filter(n >= 3)
            .select(*DRUG, "n", "r", (n - 2).alias("df"),
                    (r * F.sqrt(F.try_divide(n - 2, 1 - r * r))).alias("t"),
                    F.when(wide_enough, F.tanh(z - width)).alias("low"),
                    F.when(wide_enough, F.tanh(z + width)).alias("high")))


def with_p_value(correlation: DataFrame) -> DataFrame:
    return correlation.withColumn("p_value",
                                  student_p_value(F.col("t"), F.col("df").cast("double")))


def trend_prediction(fit: DataFrame) -> DataFrame:
    """Fitted score for every month from the start to the last one seen."""
    months = F.explode(F.sequence(F.lit(0), F.col("max_months"))).alias("month")
    return (fit.select(*DRUG, "intercept", "slope", months)
            .withColumn("predicted", F.col("intercept") + F.col("slope") * F.col("month"))
            .drop("intercept", "slope"))


def _trend_band(score: Column) -> Column:
    return (F.when(score < L.SCORE_REMISSION, L.REMISSION)
             .when(score < L.SCORE_LOW, L.TREND_LOW))


def threshold_crossing(fit: DataFrame, thresholds=L.TREND_THRESHOLDS) -> DataFrame:
    """Last month before the fitted score first falls below each threshold.

    No row if it never falls below or starts below. The score there follows from
    the line, so no curve is kept.
    """
    month, predicted = F.col("month"), F.col("predicted")
    first_below = trend_prediction(fit).groupBy(*DRUG).agg(
        *[F.min(F.when(predicted < t, month)).alias(f"below_{i}")
          for i, t in enumerate(thresholds)])
    found = F.array(*[F.struct(F.lit(t).alias("threshold"), (F.col(f"below_{i}") - 1).alias("month"))
                      for i, t in enumerate(thresholds)])
    crossings = (first_below.select(*DRUG, F.explode(found).alias("x"))
                 .select(*DRUG, "x.*").filter(month >= 0))
    rows = (join_on(crossings, fit.select(*DRUG, "intercept", "slope"), DRUG)
            .withColumn("predicted", F.col("intercept") + F.col("slope") * month)
            .drop("intercept", "slope"))
    band = _trend_band(predicted)
    label = F.concat(or_na(band), F.lit(": "), month.cast("string"), F.lit("mesos"))
    return rows.withColumn("activity", band).withColumn("label", label)


def trend_band(fit: DataFrame) -> DataFrame:
    """95% confidence band of the fitted line on the months of the prediction."""
    drugs = fit.filter(F.col("n") > 2).withColumn(
        "t", student_quantile_975((F.col("n") - 2).cast("double")))
    months = F.explode(F.sequence(F.lit(0), F.col("max_months"))).alias("month")
    grid = drugs.select(*DRUG, "intercept", "slope", "n", "mean_months", "sxx", "residual_sd",
                        "t", months)
    away = F.col("month") - F.col("mean_months")
    half = (F.col("t") * F.col("residual_sd")
            * F.sqrt(F.lit(1.0) / F.col("n") + F.try_divide(away * away, F.col("sxx"))))
    fitted = F.col("intercept") + F.col("slope") * F.col("month")
    return grid.select(*DRUG, "month", fitted.alias("predicted"), (fitted - half).alias("low"),
                       (fitted + half).alias("high"))


def trend_inverse(fit: DataFrame, points=L.TREND_POINTS) -> DataFrame:
    """Line evaluated at each score (`line_value`, the historical figure) and the
    month at which the line reaches it (`months_to_score`)."""
    a, b = F.col("intercept"), F.col("slope")
    point = F.col("score")
    return (fit.select(*DRUG, "intercept", "slope",
                       F.explode(F.array(*[F.lit(p) for p in points])).alias("score"))
            .select(*DRUG, "score", round_to(a + b * point, 1).alias("line_value"),
                    F.try_divide(point - a, b).alias("months_to_score")))


def activity_points(steps: DataFrame) -> DataFrame:
    """Points of the chart: month, score and activity band per step."""
    return steps.select(*DRUG, "months_since_first", "score",
                        activity_band(F.col("score")).alias("activity"))
