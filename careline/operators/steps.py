"""Measured steps of treatment processes and the outcome of each process.

Everything about a process is computed by one aggregation that combines on the
map side, so a process (or patient) with a very large share of the rows costs no
more than its aggregate. Row-level results join the process table back to the
steps, a join the engine may split on a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careline.functions import labels as L
from careline.functions.bands import activity_band
from careline.functions.semantics import join_on, order_key, single_valued, strict
from careline.functions.timeparts import elapsed_days, elapsed_weeks, whole_months
from careline.operators.ordered import with_previous

PROCESS = ["nhc", "process_id"]
# Attributes that describe a process and are kept in its outcome rows.
ATTRIBUTES = ["cip", "drug_code", "drug_name", "indication_code", "indication_name",
              "variable_name"]


def step_order(steps: DataFrame) -> list[str]:
    """Total order of the steps of a process: time, number, then tie-breaks."""
    return ["step_ts", "step_no", *sorted(c for c in steps.columns if c.startswith("tie"))]


def outliers(steps: DataFrame, limit: float = L.SCORE_LIMIT) -> DataFrame:
    """Quarantine of steps whose score cannot be right."""
    return steps.filter(F.col("score") > limit)


def plausible(steps: DataFrame, limit: float = L.SCORE_LIMIT) -> DataFrame:
    """Steps with a usable score; missing scores are dropped too."""
    return steps.filter(F.col("score") <= limit)


def with_activity(steps: DataFrame, cap: float | None = L.SCORE_LIMIT) -> DataFrame:
    return steps.withColumn("activity", activity_band(F.col("score"), cap))


def _nulls_last(ts: Column) -> tuple[Column, Column]:
    return ts.isNull().alias("undated"), ts.alias("at")


def _attributes(steps: DataFrame, names: list[str]) -> list[Column]:
    return [F.col(c) for c in names if c in steps.columns]


def _process_aggregates(steps: DataFrame) -> DataFrame:
    score, ts = F.col("score"), F.col("step_ts")
    # the first minimum is the earliest row among those with the lowest score
    lowest = F.when(score.isNotNull(), F.struct(score, *_nulls_last(ts)))
    return steps.groupBy(*PROCESS).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(score).alias("n_scores"),
        F.min(F.struct(order_key(*step_order(steps)), score)).getField("score")
         .alias("first_score"),
        F.min(ts).alias("first_ts"),
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
        F.min(lowest).getField("at").alias("minimum_ts"),
        F.min(F.when(score < L.SCORE_LOW, ts)).alias("low_ts"),
        F.min(F.when(score.isNull(), ts)).alias("unscored_ts"),
        F.count(F.when(ts.isNull() & F.coalesce(score < L.SCORE_LOW, F.lit(True)), 1))
         .alias("n_undated"),
    )


def _result() -> Column:
    """Result of a process from its first, lowest and highest score.

    The best change is lowest minus first unless the first score is the lowest;
    one missing score makes it unknown.
    """
    n, first = F.col("n"), F.col("first_score")
    known = F.col("n_scores") == n
    return (F.when(n == 1, L.NO_FOLLOW_UP)
             .when(known & (F.col("min_score") < first), L.SUCCESS)
             .when(known & (F.col("max_score") == first), L.NO_CHANGE)
             .when(known, L.FAILURE))


def _start_error() -> Column:
    """Whether the score was low at the start or within the first month.

    Months grow with time, so the earliest low (or missing) score decides for all.
    """
    def in_first_month(ts: str) -> Column:
        return F.coalesce(whole_months(F.col("first_ts"), F.col(ts)) == 0, F.lit(False))

    early = (F.when(in_first_month("low_ts"), True)
              .when(in_first_month("unscored_ts") | (F.col("n_undated") > 0), F.lit(None))
              .otherwise(False))
    flag = (F.col("first_score") < L.SCORE_LOW) | early
    return F.when(flag, L.YES).when(~flag, L.NO)


def pure_patients(steps: DataFrame) -> DataFrame:
    """Flag per patient: a single drug code, a missing code counting as one."""
    return steps.groupBy("nhc").agg(
        F.when(single_valued("drug_code"), L.YES).otherwise(L.NO).alias("pure_treatment"))


def process_table(steps: DataFrame, outlier_rule: str = "after") -> DataFrame:
    """One row per process with its outcome and flags.

    `outlier_rule='after'` lets an outlier act as first score and count in `n`;
    `'before'` removes outliers first.
    """
    if outlier_rule not in ("after", "before"):
        raise ValueError(f"unknown outlier rule {outlier_rule!r}")
    if outlier_rule == "before":
        steps = plausible(steps)
    table = (_process_aggregates(steps)
             .withColumn("result", _result())
             .withColumn("start_error", _start_error())
             .withColumn("days_to_minimum",
                         elapsed_days(F.col("first_ts"), F.col("minimum_ts"))))
    return join_on(table, pure_patients(steps), ["nhc"])


def with_best_change(processes: DataFrame, steps: DataFrame) -> DataFrame:
    """Add the lowest non-zero difference from the first score.

    NULL if a score is missing, infinite if no score differs. Only processes that
    never went below their first score need another look at their steps, for the
    lowest score above it.
    """
    first = F.col("first_score")
    known = F.col("n_scores") == F.col("n")
    upward = (processes.filter(known & (F.col("min_score") == first)
                               & (F.col("max_score") > first))
              .select(*PROCESS, F.col("first_score").alias("__first")))
    above = (join_on(steps.select(*PROCESS, "score"), upward, PROCESS)
             .filter(F.col("score") > F.col("__first"))
             .groupBy(*PROCESS).agg(F.min("score").alias("__above")))
    best = (F.when(~known, F.lit(None))
             .when(F.col("min_score") < first, F.col("min_score") - first)
             .when(F.col("max_score") == first, F.lit(float("inf")))
             .otherwise(F.col("__above") - first))
    return (join_on(processes, above, PROCESS, "left")
            .withColumn("best_change", best).drop("__above"))


def process_outcomes(processes: DataFrame, steps: DataFrame) -> DataFrame:
    """Distinct outcome rows: a process per attribute variant among usable steps.

    Variants are distinct rows joined to the process, however many it has.
    """
    extra = ["best_change"] if "best_change" in processes.columns else []
    variants = plausible(steps).select(
        *PROCESS, F.year("process_start").cast("int").alias("start_year"),
        *_attributes(steps, ATTRIBUTES)).distinct()
    return join_on(processes.select(*PROCESS, "n", "result", "days_to_minimum", "start_error",
                                    "pure_treatment", *extra), variants, PROCESS)


def clean(frame: DataFrame) -> DataFrame:
    """Cohort of patients on one drug whose process starts with an active disease."""
    return frame.filter((F.col("pure_treatment") == L.YES) & (F.col("start_error") == L.NO))


def step_frame(steps: DataFrame, processes: DataFrame) -> DataFrame:
    """Usable steps with their change from the first step and the process outcome."""
    extra = ["best_change"] if "best_change" in processes.columns else []
    attached = processes.select(*PROCESS, "n", "first_score", "first_ts", "result",
                                "days_to_minimum", "start_error", "pure_treatment", *extra)
    return (join_on(plausible(steps), attached, PROCESS)
            .withColumn("start_year", F.year("process_start").cast("int"))
            .withColumn("activity", activity_band(F.col("score")))
            .withColumn("difference", F.col("score") - F.col("first_score"))
            .withColumn("months_since_first",
                        whole_months(F.col("first_ts"), F.col("step_ts")).cast("int"))
            .drop("first_score", "first_ts"))


def start_in_remission(steps: DataFrame, processes: DataFrame) -> DataFrame:
    """Quality control: steps of followed-up patients whose first score is in remission.

    The first score is the patient's first usable one over all followed processes.
    """
    followed = processes.filter(F.col("n") > 1)
    rows = step_frame(steps, followed)
    first = F.min(F.struct(order_key("process_id", *step_order(steps)), F.col("score")))
    patients = (rows.groupBy("nhc").agg(first.getField("score").alias("__first"))
                .filter(F.col("__first") < L.SCORE_REMISSION).select("nhc"))
    columns = ["start_year", "nhc", "cip", "process_id", "drug_name", "step_no", "step_ts",
               "score", "activity", "result"]
    return (join_on(rows, patients, ["nhc"], "left_semi")
            .select(*[c for c in columns if c in rows.columns]))


# Follow-up ------------------------------------------------------------------

def _started_between(steps: DataFrame, first_year: int, last_year: int) -> DataFrame:
    return steps.filter(F.year("process_start").between(first_year, last_year))


def followup_gaps(steps: DataFrame, as_of_year: int) -> DataFrame:
    """Days since the previous step, for processes of this and the last three years."""
    recent = _started_between(steps, as_of_year - 3, as_of_year)
    rows = with_previous(recent, PROCESS, step_order(steps), {"previous_ts": "step_ts"})
    return (rows.withColumn("start_year", F.year("process_start").cast("int"))
                .withColumn("gap_days", elapsed_days(F.col("previous_ts"), F.col("step_ts")))
                .drop("previous_ts"))


def followup_span(steps: DataFrame, as_of_year: int) -> DataFrame:
    """First step, last step and days between them, one row per process variant.

    An undated step sorts last, so it leaves the last follow-up unknown.
    """
    names = ["cip", "drug_code", "drug_name"]
    variants = _started_between(steps, as_of_year - 3, as_of_year).select(
        *PROCESS, F.year("process_start").cast("int").alias("start_year"),
        *_attributes(steps, ["process_start", "process_end", *names])).distinct()
    spans = steps.groupBy(*PROCESS).agg(
        F.min("step_ts").alias("first_followup"),
        strict(F.max("step_ts"), "step_ts").alias("last_followup"))
    return join_on(spans.withColumn("followup_days", elapsed_days(
        F.col("first_followup"), F.col("last_followup"))), variants, PROCESS)


def process_timeline(spans: DataFrame, year: int, drug: str | None = None) -> DataFrame:
    """Start and end date of every process begun in `year`, as one row each."""
    rows = spans.filter(F.col("start_year") == year)
    if drug is not None:
        rows = rows.filter(F.col("drug_name") == drug)
    points = F.array(
        F.struct(F.lit("process_start").alias("kind"),
                 F.to_date("process_start").alias("date")),
        F.struct(F.lit("process_end").alias("kind"), F.to_date("process_end").alias("date")))
    ends = F.col("kind") == "process_end"
    label = F.when(ends & (F.col("followup_days") > 0),
                   F.concat(F.col("followup_days").cast("string"), F.lit(" dies")))
    return (rows.select(*[c for c in rows.columns if c not in ("process_start", "process_end")],
                        F.explode(points).alias("__p"))
                .select("*", "__p.*").drop("__p").withColumn("label", label))


def step_changes(steps: DataFrame) -> DataFrame:
    """Change from step to step and over the whole process.

    `span_result` keeps the superseded rule: it tests first minus lowest score
    below zero, which cannot hold, so it never says success.
    """
    spans = steps.groupBy(*PROCESS).agg(
        F.min_by("score", order_key(*step_order(steps))).alias("first_score"),
        strict(F.min("score"), "score").alias("min_score"),
        F.min("step_ts").alias("first_ts"),
        strict(F.max("step_ts"), "step_ts").alias("last_ts"))
    rows = with_previous(steps, PROCESS, step_order(steps),
                         {"previous_ts": "step_ts", "previous_score": "score"})
    first, last = F.col("first_ts"), F.col("last_ts")
    span_change = F.col("first_score") - F.col("min_score")
    return (join_on(rows, spans, PROCESS)
            .withColumn("start_year", F.year("process_start").cast("int"))
            .withColumn("activity", activity_band(F.col("score"), cap=None))
            .withColumn("step_change", F.col("score") - F.col("previous_score"))
            .withColumn("span_change", span_change)
            .withColumn("span_result", F.when(span_change < 0, L.SUCCESS_BY_SPAN)
                        .when(span_change >= 0, L.FAILURE))
            .withColumn("gap_months",
                        whole_months(F.col("previous_ts"), F.col("step_ts")).cast("int"))
            .withColumn("span_months", whole_months(first, last).cast("int"))
            .withColumn("span_weeks", elapsed_weeks(first, last))
            .drop("previous_ts", "previous_score", "first_score", "min_score",
                  "first_ts", "last_ts"))
