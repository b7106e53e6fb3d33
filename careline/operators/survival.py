"""Persistence times, Kaplan-Meier curves and log-rank tests.

Curves and tests need only how many rows share a drug group, a time and an event
flag. Times are rounded to a hundredth of a month, so that table is small
whatever the number of dispensings, and the ordered windows run over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careline.functions.rounding import round_to
from careline.functions.semantics import join_on, order_key
from careline.functions.tails import chisq_p_value, quadratic_form
from careline.functions.timeparts import months_between
from careline.operators.ordered import with_previous

SUBJECT = ["nhc", "med_group"]
# A survival of one half is recognised within this distance.
HALF_TOLERANCE = 1.5e-8
# Positions in the frequency ranking whose drugs are compared.
COMPARISONS = ((1, 2, 3, 4), (1, 2), (1, 3), (1, 4))


def _months(first: Column, last: Column) -> Column:
    return F.coalesce(round_to(months_between(first, last), 2), F.lit(0.0))


def _check(end: str, unit: str) -> None:
    if end not in ("previous", "current") or unit not in ("row", "patient"):
        raise ValueError(f"unknown end {end!r} or unit {unit!r}")


def persistence_times(rows: DataFrame, end: str = "previous") -> DataFrame:
    """Months since the first dispensing per row, and whether the row is the last one.

    By default the time runs to the previous dispensing, so the last row's time
    stops one dispensing early; `end='current'` runs to the row itself. Rows are
    distinct: of equal last rows each would be the event, where `persistence_counts` has one.
    """
    _check(end, "row")
    order = ["dispensed_at", *[c for c in rows.columns if c not in (*SUBJECT, "dispensed_at")]]
    spans = rows.groupBy(*SUBJECT).agg(F.min("dispensed_at").alias("__first"),
                                       F.max(order_key(*order)).alias("__last"))
    upto = F.col("dispensed_at")
    if end == "previous":
        rows = with_previous(rows, SUBJECT, order, {"__previous": "dispensed_at"})
        upto = F.col("__previous")
    return (join_on(rows, spans, SUBJECT)
            .withColumn("months", _months(F.col("__first"), upto))
            .withColumn("is_last", order_key(*order).eqNullSafe(F.col("__last")))
            .drop("__previous", "__first", "__last"))


def instants(valid: DataFrame) -> DataFrame:
    """One row per patient, drug group and instant, with its dispensing rows in `copies`.

    The cohort, its ranking and its curves need no more of the valid dispensings.
    """
    return valid.groupBy(*SUBJECT, "dispensed_at").agg(F.count(F.lit(1)).alias("copies"))


def with_ends(counted: DataFrame) -> DataFrame:
    """Instants with the one before, the patient's first and whether it is the last; each stands once."""
    counted = with_previous(counted, SUBJECT, ["dispensed_at"], {"before": "dispensed_at"})
    spans = counted.groupBy(*SUBJECT).agg(F.min("dispensed_at").alias("first"),
                                          F.max(order_key("dispensed_at")).alias("__last"))
    return join_on(counted, spans, SUBJECT).withColumn(
        "final", order_key("dispensed_at").eqNullSafe(F.col("__last"))).drop("__last")


def persistence_counts(rows: DataFrame, end: str = "previous", unit: str = "row",
                       copies: str | None = None, ends=with_ends) -> DataFrame:
    """Rows and events per drug group and time, without row-level windows.

    Dispensings are first counted per patient and instant. At an instant the first
    row looks back to the previous instant and the others to the instant itself;
    the very last row is the event. With `unit='patient'` only that row counts. `copies` names a column
    that says for how many dispensing rows a row stands. `ends` is how a patient's other instants are
    looked up.
    """
    _check(end, unit)
    counted = (rows.groupBy(*SUBJECT, "dispensed_at")
               .agg((F.sum(copies) if copies else F.count(F.lit(1))).alias("k")))
    now, k = F.col("dispensed_at"), F.col("k")
    marked = ends(counted)
    here = _months(F.col("first"), now)
    leading = _months(F.col("first"), F.col("before")) if end == "previous" else here
    marked = marked.select("med_group", "k", "final", here.alias("here"),
                           leading.alias("leading"))
    single, event = k == 1, F.col("final").cast("int")

    def part(months: str, rows_: Column, events: Column) -> Column:
        return F.struct(F.col(months).alias("months"), rows_.cast("bigint").alias("n"),
                        events.cast("bigint").alias("d"))

    parts = F.array(
        part("leading", F.lit(1), F.when(single, event).otherwise(0)),
        part("here", k - 1, F.when(single, 0).otherwise(event)))
    times = (marked.select("med_group", F.explode(parts).alias("p")).select("med_group", "p.*")
             .filter(F.col("n") > 0))
    if unit == "patient":
        times = times.filter(F.col("d") > 0).withColumn("n", F.col("d"))
    return summed(times)


def summed(times: DataFrame) -> DataFrame:
    """Rows and events per drug group and time; parts of the cohort add up."""
    return times.groupBy("med_group", "months").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def frequent_drugs(patients: DataFrame, more_than: int = 100) -> DataFrame:
    """Drug groups with more than `more_than` patients, ranked by patients."""
    by_patients = Window.partitionBy(F.lit(1)).orderBy(
        F.desc("patients"), F.col("med_group").asc_nulls_last())
    return (patients.filter((F.col("patients") > more_than) & F.col("med_group").isNotNull())
            .select("med_group", "patients", F.row_number().over(by_patients).alias("position")))


def ranked_counts(counts: DataFrame, ranked: DataFrame, positions=None) -> DataFrame:
    """Counts of the ranked drug groups: all of them, or those at the given positions."""
    chosen = ranked if positions is None else ranked.filter(F.col("position").isin(*positions))
    return join_on(counts, chosen.select("med_group", "position"), ["med_group"])


def kaplan_meier(counts: DataFrame) -> DataFrame:
    """Survival per drug group and time: at risk, events, censored, running events."""
    later = (Window.partitionBy("med_group").orderBy("months")
             .rowsBetween(Window.currentRow, Window.unboundedFollowing))
    upto = (Window.partitionBy("med_group").orderBy("months")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at_risk = counts.withColumn("at_risk", F.sum("n").over(later))
    return (at_risk
            .withColumn("survival", F.product(1.0 - F.col("d") / F.col("at_risk")).over(upto))
            .select("med_group", "months", "at_risk", F.col("d").alias("events"),
                    (F.col("n") - F.col("d")).alias("censored"), "survival",
                    F.sum("d").over(upto).alias("cumulative_events")))


def median_survival(curve: DataFrame) -> DataFrame:
    """First time the survival reaches one half.

    If it equals one half there, the middle between that time and the next drop.
    """
    half = 0.5
    reached = F.col("survival") <= half + HALF_TOLERANCE
    below = F.col("survival") < half - HALF_TOLERANCE
    found = curve.groupBy("med_group").agg(
        F.min(F.when(reached, F.col("months"))).alias("at"),
        F.min(F.when(below, F.col("months"))).alias("next"))
    level = F.col("at") < F.col("next")
    return found.select("med_group", F.when(level, (F.col("at") + F.col("next")) / 2)
                        .otherwise(F.col("at")).alias("median_months"))


# Log-rank ---------------------------------------------------------------------

def comparison_name(positions) -> str:
    return "_".join(str(p) for p in positions)


def memberships(counts: DataFrame, comparisons=COMPARISONS, whole: str | None = None) -> DataFrame:
    """(comparison, position, med_group): the drugs of each comparison.

    `comparisons` name positions of the ranking; one that no drug holds has no row. `whole` is the
    name of one more comparison of all drugs there are.
    """
    ranked = counts.select("position", "med_group").distinct()
    names = [F.when(F.col("position").isin(*c), F.lit(comparison_name(c))) for c in comparisons]
    if whole is not None:
        names.append(F.lit(whole))
    return (ranked.select(F.explode(F.array(*names)).alias("comparison"), "position", "med_group")
            .filter(F.col("comparison").isNotNull()))


def _at_risk(counts: DataFrame, comparisons, whole: str | None) -> DataFrame:
    """(comparison, months, position, n, d, r): every drug of a comparison at every time of it.

    A drug is at risk also at times at which only others have rows, so the table has as many rows
    as times and drugs of each comparison multiply to, whatever the number of dispensings.
    """
    members = memberships(counts, comparisons, whole)
    own = join_on(members, counts.select("med_group", "months", "n", "d"), ["med_group"])
    times = own.select("comparison", "months").distinct()
    grid = times.join(members.select("comparison", "position"), "comparison")
    filled = grid.join(own.select("comparison", "months", "position", "n", "d"),
                       ["comparison", "months", "position"], "left").fillna(0, ["n", "d"])
    later = (Window.partitionBy("comparison", "position").orderBy("months")
             .rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return filled.withColumn("r", F.sum("n").over(later))


def _shares(at_risk: DataFrame) -> DataFrame:
    """`at_risk` with each drug's share of the rows at risk, and the time's events and spread."""
    total = at_risk.groupBy("comparison", "months").agg(
        F.sum("r").cast("double").alias("all_r"), F.sum("d").cast("double").alias("all_d"))
    spread = F.when(F.col("all_r") > 1, F.col("all_d") * (F.col("all_r") - F.col("all_d"))
                    / (F.col("all_r") - 1.0)).otherwise(0.0)
    return (at_risk.join(total, ["comparison", "months"])
            .withColumn("share", F.col("r") / F.col("all_r")).withColumn("spread", spread))


def _observed_expected(shares: DataFrame) -> DataFrame:
    return shares.groupBy("comparison", "position").agg(
        F.sum("n").alias("n"), F.sum("d").alias("observed"),
        F.sum(F.col("all_d") * F.col("share")).alias("expected"))


def logrank_observed_expected(counts: DataFrame, comparisons=COMPARISONS,
                              whole: str | None = None) -> DataFrame:
    """Observed and expected events of every drug of `memberships` in its comparisons."""
    rows = _observed_expected(_shares(_at_risk(counts, comparisons, whole)))
    return join_on(rows, counts.select("position", "med_group").distinct(), ["position"])


def logrank_covariance(counts: DataFrame, comparisons=COMPARISONS,
                       whole: str | None = None) -> DataFrame:
    """(comparison, p, q, covariance) of the events of each pair of drugs, p <= q.

    One row per time and pair is reduced by pair, so the number of drugs is free.
    """
    return _covariance(_shares(_at_risk(counts, comparisons, whole)))


def _covariance(shares: DataFrame) -> DataFrame:
    a = shares.select("comparison", "months", F.col("position").alias("p"),
                      F.col("share").alias("share_p"), "spread")
    b = shares.select("comparison", "months", F.col("position").alias("q"),
                      F.col("share").alias("share_q"))
    same = F.when(F.col("p") == F.col("q"), 1.0).otherwise(0.0)
    return (a.join(b, ["comparison", "months"]).filter(F.col("p") <= F.col("q"))
            .groupBy("comparison", "p", "q")
            .agg(F.sum(F.col("spread") * F.col("share_p") * (same - F.col("share_q")))
                 .alias("covariance")))


def logrank_test(counts: DataFrame, comparisons=COMPARISONS, whole: str | None = None) -> DataFrame:
    """Statistic and p-value of every comparison of `memberships`, each from its own statistic.

    A drug without rows does not take part; with a single drug left there is no statistic. The last
    step has one row per comparison, with its matrix.
    """
    shares = _shares(_at_risk(counts, comparisons, whole))
    entry = F.struct(F.col("position"), (F.col("observed") - F.col("expected")).alias("distance"),
                     F.col("n"))
    distances = (_observed_expected(shares).groupBy("comparison")
                 .agg(F.array_sort(F.collect_list(entry)).alias("drugs")))
    half = _covariance(shares)
    mirrored = half.unionByName(half.filter(F.col("p") < F.col("q")).select(
        "comparison", F.col("q").alias("p"), F.col("p").alias("q"), "covariance"))
    matrices = mirrored.groupBy("comparison").agg(F.array_sort(F.collect_list(
        F.struct("p", "q", "covariance"))).alias("cells"))
    return (distances.join(matrices, "comparison")
            .select("comparison",
                    quadratic_form(F.col("drugs.distance"), F.col("cells.covariance"),
                                   F.col("drugs.n")).alias("chisq"),
                    (F.size(F.filter("drugs", lambda x: x["n"] > 0)) - 1).alias("df"))
            .withColumn("p_value", chisq_p_value(F.col("chisq"), F.col("df").cast("double"))))
