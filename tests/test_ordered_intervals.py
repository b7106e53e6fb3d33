"""Previous-row lookup and interval joins against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from careline.operators.intervals import _sliced, earliest_interval, interval_join
from careline.operators.ordered import sliced, with_previous

DAY0 = dt.datetime(2015, 1, 1)


def events(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(20)}",
             None if rng.random() < 0.03 else
             DAY0 + dt.timedelta(days=rng.randrange(40), hours=rng.randrange(24)),
             i, float(rng.randrange(5))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, at timestamp_ntz, tie int, v double")


def brute_previous(rows):
    last, out = {}, []
    for row in sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or DAY0, *r[2:])):
        out.append((*row, *(last.get(row[0], (None, None)))))
        last[row[0]] = (row[1], row[3])
    return sorted(out, key=str)


def test_previous_row(spark):
    rows, frame = events(spark)
    got = with_previous(frame, ["k"], ["at", "tie"], {"p_at": "at", "p_v": "v"})
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_previous(rows)


def test_no_key_day_or_undated_row_needs_one_slice(spark):
    """One key has all rows on one instant, one has no dates, one many equal rows."""
    rows = ([("day", DAY0, i, float(i)) for i in range(900)]
            + [("undated", None, i, float(i)) for i in range(900)]
            + [("equal", DAY0, 1, 2.0)] * 900 + [("cold", DAY0, 1, 1.0)])
    frame = spark.createDataFrame(rows, "k string, at timestamp_ntz, tie int, v double").repartition(5)
    got = with_previous(frame, ["k"], ["at", "tie"], {"p_at": "at", "p_v": "v"})
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_previous(rows)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        slices = sliced(frame, ["k"], ["at", "tie"]).groupBy("__slice").count().collect()
    finally:
        spark.conf.set(name, before)
    assert len(slices) == 8 and max(r["count"] for r in slices) < 2 * len(rows) / 8


def intervals(spark, n=120, seed=2):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        start = DAY0 + dt.timedelta(days=rng.randrange(-10, 40))
        end = None if rng.random() < 0.2 else start + dt.timedelta(days=rng.randrange(-2, 15))
        rows.append((f"k{rng.randrange(5)}", rng.choice([None, 1.0, 2.0, 7.0]), start, end))
    return rows, spark.createDataFrame(
        rows, "key string, value double, start timestamp_ntz, end timestamp_ntz")


@pytest.mark.parametrize("slice_days", [3, 365])
@pytest.mark.parametrize("as_of", ["2015-02-01", None])
def test_interval_join(spark, slice_days, as_of):
    rng = random.Random(3)
    ev = [(f"k{rng.randrange(6)}", DAY0 + dt.timedelta(days=rng.randrange(40)), i) for i in range(80)]
    frame = spark.createDataFrame(ev, "k string, at timestamp_ntz, id int")
    iv, ranges = intervals(spark)
    limit = None if as_of is None else dt.datetime.fromisoformat(as_of)

    def inside(at, start, end):
        stop = end or limit
        return stop is not None and start <= at <= stop

    got = interval_join(frame, ranges, [("k", "key")], "at", "start", "end", as_of,
                        slice_days=slice_days)
    expected = [(k, at, i, v, s, e) for k, at, i in ev for key, v, s, e in iv
                if key == k and inside(at, s, e)]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(expected, key=str)

    first = earliest_interval(frame, ranges, [("k", "key")], "at", "start", "end", "value", as_of)
    expected_first = []
    for k, at, i in ev:
        hits = [(s, v is None, v) for key, v, s, e in iv if key == k and inside(at, s, e)]
        expected_first.append((k, at, i, min(hits, key=lambda h: (h[0], h[1], h[2] or 0))[2]
                               if hits else None))
    assert sorted((tuple(r) for r in first.collect()), key=str) == sorted(expected_first, key=str)


def test_far_ends_and_a_heavy_key(spark):
    """An end in the year 9999 costs a row for each slice with events, not for each year."""
    far = dt.datetime(9999, 12, 31)
    rows = ([("hot", float(i % 3), DAY0 + dt.timedelta(days=i % 20), far) for i in range(400)]
            + [("k0", 1.0, DAY0, DAY0 + dt.timedelta(days=5))])
    ranges = spark.createDataFrame(rows, "key string, value double, start timestamp_ntz, end timestamp_ntz")
    frame = spark.createDataFrame([("hot", DAY0 + dt.timedelta(days=d), d) for d in range(25)],
                                  "k string, at timestamp_ntz, id int")
    copies = _sliced(frame, "at", ranges, "start", "end", None, 365)
    assert copies.count() == len(rows)
    got = earliest_interval(frame, ranges, [("k", "key")], "at", "start", "end", "value", None)
    assert [r.value for r in got.collect()] == [0.0] * 25
    joined = interval_join(frame, ranges, [("k", "key")], "at", "start", "end", None)
    assert joined.count() == sum(1 for d in range(25) for i in range(400) if i % 20 <= d)


def test_rows_are_exchanged_once_and_nothing_is_written(spark, tmp_path):
    rows, frame = events(spark)
    frame.write.parquet(str(tmp_path / "t"))
    got = with_previous(spark.read.parquet(str(tmp_path / "t")), ["k"], ["at", "tie"], {"p": "at"})
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("+- Exchange") == 1 and "__slice" in plan


def test_running_max(spark):
    from careline.operators.ordered import with_running_max

    rng = random.Random(4)
    rows = [("hot" if i % 3 == 0 else rng.choice("abc"), rng.randrange(500), i,
             rng.choice([None, *range(1000)])) for i in range(1500)]
    frame = spark.createDataFrame(rows, "k string, at int, tie int, v int").repartition(5)
    got = with_running_max(frame, ["k"], ["at", "tie"], "top", F.col("v"))
    want, top = [], {}
    for k, at, tie, v in sorted(rows):
        want.append((k, at, tie, v, top.get(k)))
        top[k] = max((x for x in (top.get(k), v) if x is not None), default=None)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_a_patient_with_a_third_of_all_beginnings(spark):
    """Beginnings and events of one key are cut; what rules at an instant crosses the cuts."""
    rows = [("hot" if i % 3 == 0 else f"k{i % 200}", float(i % 7),
             DAY0 + dt.timedelta(seconds=i), DAY0 + dt.timedelta(seconds=i + (5000 if i == 3 else 40)))
            for i in range(3000)]
    ranges = spark.createDataFrame(rows, "key string, value double, start timestamp_ntz, end timestamp_ntz")
    ev = [("hot", DAY0 + dt.timedelta(seconds=s), s) for s in range(-5, 6000, 7)]
    frame = spark.createDataFrame(ev, "k string, at timestamp_ntz, id int")
    got = {r.id: r.value for r in earliest_interval(
        frame, ranges, [("k", "key")], "at", "start", "end", "value", None).collect()}
    own = sorted((s, v, e) for k, v, s, e in rows if k == "hot")
    for _, at, i in ev:
        hits = [v for s, v, e in own if s <= at <= e]
        assert got[i] == (hits[0] if hits else None)
    parts = sliced(ranges, ["key"], ["start", "value"]).groupBy("__slice", "key").count().collect()
    assert max(r["count"] for r in parts) < 2 * len(rows) / 8
    assert len({r["__slice"] for r in parts if r.key == "hot"}) > 1


def test_an_event_and_an_interval_in_the_year_9999(spark):
    """Only the key with an event there has a copy there, and none in the years between."""
    far = dt.datetime(9999, 12, 31)
    ranges = spark.createDataFrame(
        [("a", 1.0, DAY0, far), ("b", 2.0, DAY0, far), ("c", 3.0, DAY0, far)],
        "key string, value double, start timestamp_ntz, end timestamp_ntz")
    frame = spark.createDataFrame([("a", far, 1), ("a", DAY0, 2), ("b", DAY0, 3), ("d", far, 4)],
                                  "k string, at timestamp_ntz, id int")
    copies = _sliced(frame, "at", ranges, "start", "end", None, 365, [("k", "key")])
    assert sorted(r.key for r in copies.collect()) == ["a", "a", "b"]
    joined = interval_join(frame, ranges, [("k", "key")], "at", "start", "end", None)
    assert sorted(r.id for r in joined.collect()) == [1, 2, 3]
    got = earliest_interval(frame, ranges, [("k", "key")], "at", "start", "end", "value", None)
    assert {r.id: r.value for r in got.collect()} == {1: 1.0, 2: 1.0, 3: 2.0, 4: None}
    whole = spark.createDataFrame([("a", far, 1)], "k string, at timestamp_ntz, id int")
    ends = spark.createDataFrame([("a", 1.0, far, far)], ranges.schema)
    assert interval_join(whole, ends, [("k", "key")], "at", "start", "end", None).count() == 1
    assert earliest_interval(whole, ends, [("k", "key")], "at", "start", "end", "value",
                             None).first().value == 1.0


def test_no_rows_at_all(spark):
    frame = spark.createDataFrame([], "k string, at timestamp_ntz, id int")
    ranges = spark.createDataFrame([], "k string, value double, start timestamp_ntz, end timestamp_ntz")
    assert with_previous(frame, ["k"], ["at", "id"], {"p": "at"}).collect() == []
    assert interval_join(frame, ranges, ["k"], "at", "start", "end", None).collect() == []
    assert earliest_interval(frame, ranges, ["k"], "at", "start", "end", "value", None).collect() == []
