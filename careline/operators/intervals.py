"""Joining events to the validity intervals that contain them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careline.functions.semantics import join_apart, join_on
from careline.functions.timeparts import day_number
from careline.operators.ordered import with_running_max

# Width of the time slices, in days. A slice is part of the join key.
SLICE_DAYS = 365


def closed_end(end: Column, as_of: str | None) -> Column:
    """End of an interval; an open one lasts until `as_of` (or stays open: NULL)."""
    return end if as_of is None else F.coalesce(end, F.lit(as_of).cast("timestamp_ntz"))


def _slice_of(ts: Column, slice_days: int) -> Column:
    return F.floor(day_number(ts) / F.lit(slice_days)).cast("int")


def _closed(intervals: DataFrame, start: str, end: str, as_of: str | None) -> DataFrame:
    """Intervals that contain anything, with their end in `__stop`."""
    return (intervals.withColumn("__stop", closed_end(F.col(end), as_of))
            .filter(F.col(start) <= F.col("__stop")))


def _sliced(events: DataFrame, at: str, intervals: DataFrame, start: str, end: str,
            as_of: str | None, slice_days: int, keys=()) -> DataFrame:
    """A copy of every interval per time slice it touches, its end in `__stop`.

    Only slices that hold events of the interval's key count, so an end in the year 9999 costs a copy
    only if the key has events there. What is known of a key is the list of its slices, at most
    as many as the calendar has.
    """
    pairs = [(k, k) if isinstance(k, str) else k for k in keys]
    left = [a for a, _ in pairs]
    occupied = (events.filter(F.col(at).isNotNull())
                .groupBy(*left).agg(F.collect_set(_slice_of(F.col(at), slice_days)).alias("__slices")))
    first, last = _slice_of(F.col(start), slice_days), _slice_of(F.col("__stop"), slice_days)
    met = F.filter("__slices", lambda s: (s >= first) & (s <= last))
    return (join_apart(_closed(intervals, start, end, as_of), occupied, [(b, a) for a, b in pairs])
            .withColumn("__slice", F.explode(met)).drop("__slices"))


def interval_join(events: DataFrame, intervals: DataFrame, keys, at: str, start: str, end: str,
                  as_of: str | None, slice_days: int = SLICE_DAYS) -> DataFrame:
    """Pairs with equal keys and start <= at <= end (NULL end = `as_of`).

    An interval is copied to every time slice it touches and its key has events in, and an event belongs
    to one slice, so a pair meets once and only events and intervals of the same slice are compared.
    That keeps the pairs looked at near the pairs returned for keys with long histories, and cuts a
    hot key into one key per slice.
    """
    at_slice = events.withColumn("__at_slice", _slice_of(F.col(at), slice_days))
    inside = (F.col(at) >= F.col(start)) & (F.col(at) <= F.col("__stop"))
    copies = _sliced(events, at, intervals, start, end, as_of, slice_days, keys)
    return (join_on(at_slice, copies, [*keys, ("__at_slice", "__slice")], "inner", inside)
            .drop("__stop", "__at_slice"))


def stretches(intervals: DataFrame, keys: list[str], start: str, end: str, value: str,
              as_of: str | None, running_max=with_running_max) -> DataFrame:
    """(keys, begin, stop, value): disjoint, each ruled by the interval that began first there.

    Of intervals that began together the lowest value rules, a missing one last. In this order an interval
    rules only after the end of all before it, which is a running maximum. Intervals that begin
    together with one value are one before that.
    """
    once = (_closed(intervals, start, end, as_of).groupBy(*keys, start, value)
            .agg(F.max("__stop").alias("__stop")))
    ruled = running_max(once, keys, [start, value], "__after", F.col("__stop"))
    tick = F.expr("INTERVAL '0.000001' SECOND")
    return (ruled.filter(F.col("__after").isNull() | (F.col("__stop") > F.col("__after")))
            .select(*keys, F.greatest(F.col(start), F.col("__after") + tick).alias("begin"),
                    F.col("__stop").alias("stop"), value))


def earliest_interval(events: DataFrame, intervals: DataFrame, keys, at: str, start: str,
                      end: str, value: str, as_of: str | None,
                      running_max=with_running_max) -> DataFrame:
    """For each event the `value` of the interval that contains it and began first.

    Of intervals that began together the lowest value counts, a missing one last. `stretches` makes
    them disjoint, so only the last stretch that began by then can contain an event. Events and
    stretches go into one order, in which the last stretch is a running maximum: no pairs are built,
    and a key with a third of all rows is cut into range slices. An event without interval gets NULL,
    and so does one without time. `running_max` is how the rows before are looked up.
    """
    pairs = [(k, k) if isinstance(k, str) else k for k in keys]
    names = [f"__k{i}" for i in range(len(pairs))]
    ruled = stretches(intervals.select(*[F.col(b).alias(n) for (_, b), n in zip(pairs, names)],
                                       start, end, value), names, start, end, value, as_of, running_max)
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields]
    mark = F.struct("begin", "stop", F.col(value).alias("value"))
    events = events.select(*events.columns, *[F.col(a).alias(n) for (a, _), n in zip(pairs, names)],
                           F.col(at).alias("__at"), F.lit(1).alias("__event"))
    marked = ruled.select(*nothing, *names, F.col("begin").alias("__at"), F.lit(0).alias("__event"),
                          mark.alias("__stretch"))
    both = marked.unionByName(events, allowMissingColumns=True)
    columns = [f.name for f in events.schema.fields if f.name not in (*names, "__at", "__event")]
    looked = running_max(both, names, ["__at", "__event", *columns], "__last", F.col("__stretch"))
    inside = F.col("__at") <= F.col("__last.stop")
    return (looked.filter("__event = 1")
            .select(*columns, F.when(inside, F.col("__last.value")).alias(value)))
