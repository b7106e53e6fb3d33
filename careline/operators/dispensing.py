"""Dispensings, prescriptions and the join between them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careline.functions import labels as L
from careline.functions.posology import posology_days
from careline.functions.semantics import is_in, join_apart, join_on, repeated, single_valued
from careline.functions.text import strip_zeros
from careline.functions.timeparts import elapsed_days
from careline.operators.intervals import SLICE_DAYS, earliest_interval, interval_join
from careline.operators.ordered import with_previous, with_running_max

MATCH = ["nhc", "med_code"]
DISPENSED = ["nhc", "cip", "episode", "med_code", "med_group", "med_name", "national_code",
             "dispensed_at", "qty"]
PRESCRIBED = ["freq_desc", "posology_days", "valid_from", "valid_to"]


def present(frame: DataFrame, names: list[str]) -> list[str]:
    return [c for c in names if c in frame.columns]


def valid_ids(frame: DataFrame, column: str, invalid=L.INVALID_IDS) -> DataFrame:
    """Rows with a usable patient id."""
    return frame.filter(F.col(column).isNotNull() & ~is_in(F.col(column), invalid))


def dispensing_order(dispensings: DataFrame) -> list[str]:
    return ["dispensed_at", *sorted(c for c in dispensings.columns if c.startswith("tie"))]


def dispensing_gaps(dispensings: DataFrame) -> DataFrame:
    """Non-empty dispensings with the days since the previous one of the same drug.

    Empty dispensings take part in the gaps and are dropped afterwards; the gaps
    use the patient id as delivered, the result the id without leading zeros.
    """
    rows = with_previous(dispensings, ["nhc_raw", "med_name"], dispensing_order(dispensings),
                         {"previous_at": "dispensed_at"})
    return _without_empty(
        rows.withColumn("gap_days", elapsed_days(F.col("previous_at"), F.col("dispensed_at")))
            .drop("previous_at"))


def dispensed(dispensings: DataFrame) -> DataFrame:
    """Non-empty dispensings with the patient id used in joins, without the gaps."""
    return _without_empty(dispensings)


def _without_empty(rows: DataFrame) -> DataFrame:
    return (rows.withColumn("nhc", strip_zeros(F.col("nhc_raw"))).drop("nhc_raw")
                .filter(F.col("qty") != 0))


def with_posology(prescriptions: DataFrame) -> DataFrame:
    return prescriptions.withColumn(
        "posology_days",
        posology_days(F.col("freq_type"), F.col("freq_code"), F.col("freq_desc")))


def prescription_extract(prescriptions: DataFrame) -> DataFrame:
    """Quality control: the prescriptions as loaded, identifying columns only."""
    return prescriptions.select(*present(prescriptions, [
        "nhc", "presc_cip", "med_code", "med_name", "presc_national_code",
        "presc_specialty_name", "valid_from", "valid_to"]))


def dispensing_prescriptions(rows: DataFrame, prescriptions: DataFrame) -> DataFrame:
    """Every dispensing with every prescription of its patient and drug, if any.

    All pairs are the result here. The operators below need only valid pairs or
    flags and do not go through this table.
    """
    return join_on(rows, prescriptions, MATCH, "left")


def _large(frame: DataFrame, piece: int) -> DataFrame:
    """Keys with more than `piece` distinct rows and their number of pieces: at most one key a `piece`.

    Rows go into it as digests. A digest two rows share only leaves a piece a little fuller.
    """
    digests = frame.select(*MATCH, F.xxhash64(*frame.columns).alias("__digest")).distinct()
    return (digests.groupBy(*MATCH).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > piece)
            .select(*MATCH, F.ceil(2 * F.col("__n") / piece).alias("__pieces")))


def _dealt(frame: DataFrame, name: str, piece: int | None, large: DataFrame | None) -> DataFrame:
    """(keys, piece, the row as a struct). Keys with few rows have one piece; the rows of others are dealt
    to pieces by a hash of the row, half full on average, so that a repeated task deals them alike."""
    row = F.struct(*[c for c in frame.columns if c not in MATCH]).alias(name)
    if piece is None:
        return frame.select(*MATCH, F.lit(0).cast("long").alias("piece"), row)
    dealt = F.pmod(F.xxhash64(*frame.columns), F.coalesce("__pieces", F.lit(1)))
    return (join_on(frame, F.broadcast(large), MATCH, "left")
            .select(*MATCH, dealt.cast("long").alias("piece"), row))


def paired_histories(rows: DataFrame, prescriptions: DataFrame, piece: int | None = 1000) -> DataFrame:
    """The pairs of `dispensing_prescriptions`, factorised: each row stands once, whatever its partners.

    One row per patient, drug and piece: `dispensings` and `prescriptions` are lists of rows with `copies`,
    NULL where a side has fewer pieces. Every dispensing of a key is paired with every prescription
    of it, across pieces, so the table grows with the rows of a key and not with their product.
    Prescriptions of keys without dispensings are left out. Both sides are counted and gathered together;
    `piece=None` says that no key has many rows, so that each is one piece.
    """
    place, sides = [*MATCH, "piece"], ["dispensing", "prescription"]
    left = right = several = None
    if piece is not None:
        left, right = _large(rows, piece), _large(prescriptions, piece)
        met = join_on(rows.select(*MATCH), F.broadcast(right.select(*MATCH)), MATCH).distinct()
        unmet = join_on(right.select(*MATCH), met, MATCH, "left_anti")
        prescriptions = join_on(prescriptions, F.broadcast(unmet), MATCH, "left_anti")
        several = left.select(*MATCH).union(met).distinct().withColumn("__kept", F.lit(True))
    dealt = _dealt(prescriptions, "prescription", piece, right).withColumn("__kept", F.lit(False))
    if several is not None:
        dealt = join_on(dealt.drop("__kept"), F.broadcast(several), MATCH, "left")
    both = _dealt(rows, "dispensing", piece, left).unionByName(dealt, allowMissingColumns=True)
    counted = both.groupBy(*place, *sides, "__kept").agg(F.count(F.lit(1)).alias("copies"))
    found = counted.groupBy(*place).agg(
        *[F.collect_list(F.when(F.col(s).isNotNull(), F.struct(f"{s}.*", "copies"))).alias(f"{s}s")
          for s in sides], F.max(F.coalesce("__kept", F.lit(False))).alias("__kept"))
    # a row of prescriptions alone belongs to a key whose dispensings lie in other pieces, or to none
    return (found.filter((F.size("dispensings") > 0) | F.col("__kept"))
            .select(*place, *[F.when(F.size(f"{s}s") > 0, F.col(f"{s}s")).alias(f"{s}s") for s in sides]))


def history_counts(histories: DataFrame) -> DataFrame:
    """Per patient and drug: dispensings, prescriptions, those with an id, pairs and whether it is matched."""
    def rows_of(name: str, chosen=lambda x: F.lit(True)) -> Column:
        return F.sum(F.coalesce(F.aggregate(name, F.lit(0).cast("long"), lambda n, x: n + F.when(
            chosen(x), x["copies"]).otherwise(0)), F.lit(0)))
    identified = F.col("identified")
    return (histories.groupBy(*MATCH).agg(
        rows_of("dispensings").alias("dispensings"), rows_of("prescriptions").alias("prescriptions"),
        rows_of("prescriptions", lambda x: x["prescription_id"].isNotNull()).alias("identified"))
        .withColumn("pairs", F.col("dispensings") * F.greatest("prescriptions", F.lit(1)))
        .withColumn("matched", identified > 0)
        .withColumn("unmatched", (F.col("prescriptions") == 0) | (identified < F.col("prescriptions"))))


def expanded_pairs(histories: DataFrame) -> DataFrame:
    """The pairs themselves, as `dispensing_prescriptions` returns them."""
    def listed(name: str) -> DataFrame:
        one = histories.select(*MATCH, F.explode(name).alias("x")).select(*MATCH, "x.*")
        return repeated(one, "copies").drop("__copy")
    return join_on(listed("dispensings"), listed("prescriptions"), MATCH, "left")


def expanded_within(histories: DataFrame) -> DataFrame:
    """`expanded_pairs` where every key is one piece: its two lists are paired where they lie."""
    def listed(frame: DataFrame, name: str) -> DataFrame:
        kept = [c for c in frame.columns if c != name]
        one = frame.select(*kept, F.explode_outer(name).alias("x")).select(*kept, "x.*")
        return repeated(one.withColumn("copies", F.coalesce("copies", F.lit(1).cast("long"))),
                        "copies").drop("__copy")
    pairs = listed(histories.filter(F.col("dispensings").isNotNull()).drop("piece"), "dispensings")
    own = [c for c in pairs.columns if c not in (*MATCH, "prescriptions")]
    return listed(pairs.select(*MATCH, *own, "prescriptions"), "prescriptions")


def matched_dispensings(rows: DataFrame, prescriptions: DataFrame) -> DataFrame:
    """Dispensing-prescription pairs only."""
    return join_on(rows, prescriptions.filter(F.col("prescription_id").isNotNull()), MATCH)


def unmatched_dispensings(rows: DataFrame, prescriptions: DataFrame) -> DataFrame:
    """Quality control: dispensings that no identified prescription accounts for.

    Either there is no prescription for patient and drug, or one without an id,
    which is then shown.
    """
    alone = join_on(rows, prescriptions.select(*MATCH).distinct(), MATCH, "left_anti")
    unidentified = join_on(rows, prescriptions.filter(F.col("prescription_id").isNull()), MATCH)
    return alone.unionByName(unidentified, allowMissingColumns=True).distinct()


def valid_dispensings(rows: DataFrame, prescriptions: DataFrame, as_of: str,
                      slice_days: int = SLICE_DAYS) -> DataFrame:
    """Distinct dispensings within the validity of a prescription.

    Two overlapping prescriptions that differ in a kept column keep the dispensing
    twice. Both sides are reduced to distinct rows before they meet; as all their
    columns are kept, the pairs are then distinct too.
    """
    left = rows.select(*present(rows, DISPENSED)).distinct()
    right = (prescriptions.filter(F.col("prescription_id").isNotNull())
             .select(*MATCH, *PRESCRIBED).distinct())
    joined = interval_join(left, right, MATCH, "dispensed_at", "valid_from", "valid_to", as_of,
                           slice_days=slice_days)
    return joined.select(*left.columns, *PRESCRIBED)


def overlap_counts(*valid: DataFrame) -> DataFrame:
    """Quality control: dispensings that overlapping prescriptions multiply, and the rows added.

    Of several parts no two share a dispensing; each is grouped where it lies.
    """
    per_dispensing = reduce(DataFrame.unionByName, [
        part.groupBy(*present(part, DISPENSED)).agg(F.count(F.lit(1)).alias("k")).select("k")
        for part in valid])
    several = F.when(F.col("k") > 1, F.lit(1)).otherwise(0)
    return per_dispensing.agg(F.count(F.lit(1)).alias("dispensings"),
                              F.coalesce(F.sum(several), F.lit(0)).alias("multiplied"),
                              F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("added_rows"))


def _numbered(frame: DataFrame, code: str) -> DataFrame:
    return frame.withColumns({"__nhc": F.col("nhc").try_cast("double"),
                              "__code": F.col(code).cast("string").try_cast("double")})


_NUMBERED = ["__nhc", "__code"]


def interval_join_by_code(rows: DataFrame, prescriptions: DataFrame, as_of: str | None,
                          slice_days: int = SLICE_DAYS) -> DataFrame:
    """Valid prescriptions per dispensing, matched by national code as a number."""
    known = prescriptions.filter(F.col("prescription_id").isNotNull()).select(*MATCH).distinct()
    left = join_on(rows.select(*present(rows, DISPENSED)), known, MATCH, "left_semi").distinct()
    right = _numbered(prescriptions, "presc_national_code").select(
        *_NUMBERED, "posology_days", "valid_from", "valid_to")
    return (interval_join(_numbered(left, "national_code"), right, _NUMBERED, "dispensed_at",
                          "valid_from", "valid_to", as_of, slice_days=slice_days)
            .drop(*_NUMBERED))


def point_in_time_posology(rows: DataFrame, prescriptions: DataFrame,
                           as_of: str | None, running_max=with_running_max) -> DataFrame:
    """Posology in force at each dispensing, by patient and national code.

    Of several prescriptions in force the one that began first decides; NULL if
    there is none.
    """
    events = rows.select("nhc", "national_code", "dispensed_at").distinct()
    intervals = (prescriptions.select("nhc", "presc_national_code", "posology_days",
                                      "valid_from", "valid_to").distinct())
    return earliest_interval(events, intervals, ["nhc", ("national_code", "presc_national_code")],
                             "dispensed_at", "valid_from", "valid_to", "posology_days", as_of, running_max)


def one_group_patients(rows: DataFrame, key: str = "nhc") -> DataFrame:
    """Patients with a flag whether they ever took a single drug group."""
    return rows.groupBy(key).agg(
        F.when(single_valued("med_group"), L.YES).otherwise(L.NO).alias("naive"))
