from types import SimpleNamespace

from pyspark.sql import functions as F

from careline.plans.registry import _extract
from careline.sources import delimited as T


def test_an_extract_makes_its_rows_once(spark):
    """Two files of it, but what stands behind them is computed for one."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = (spark.range(50).selectExpr("cast(id as string) AS nhc", "'x' AS cip")
            .mapInArrow(counted, "nhc string, cip string"))
    columns = (("NHC", "nhc", "text"), ("CIP", "cip", "text"))
    folder = _extract(SimpleNamespace(spark=spark), rows, columns,
                      {"nhc": F.col("nhc"), "cip": F.col("cip")}, F.col("nhc") == "7")
    assert seen.value == 50
    got = T.canonical(T.read_delimited(spark, folder), columns).collect()
    assert sorted((r.nhc or "", r.cip) for r in got) == sorted(
        ("" if i == 7 else str(i), "x") for i in range(50))


def test_plain_times_are_what_their_layout_gives(spark):
    texts = ["2020-01-31 10:20:30", "2020-01-31T10:20:30+02:00", "2020-01-31 10:20:30Z", "20200131102030",
             "2020-02-31 10:20:30", "20200231102030", "2020-01-31 24:00:00", "20200131106030",
             "2020-01-31 10:20:30-19:00", "2020-01-31 10:20:30+25:00", "0000-01-31 10:20:30", "0000-00-00 00:00:00",
             "2020-01-31 10:20:30\n", "20200131102030\n", " 2020-01-31 10:20:30", "2020-01-31 10:20",
             "2020-01-31", "2020013110203", "202001311020301", "20-01-31 10:20:30", "2020-1-31 1:2:3",
             "2020-01-31 10:20:30.5", "20200131 102030", "", None]
    by_layout = F.lit(None).cast("timestamp")
    for layout in reversed(T.DATE_TIMES):
        by_layout = F.when(F.col("t").rlike(layout), T._in_layout(F.col("t"), layout)).otherwise(by_layout)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    got = rows.select("t", T.to_time(F.col("t")).cast("string").alias("a"), by_layout.cast("string").alias("b"),
                      T.to_time(F.col("t")).cast("long").alias("n"), by_layout.cast("long").alias("m")).collect()
    assert all((r.a, r.n) == (r.b, r.m) for r in got)
    assert sum(r.a is not None for r in got) >= 8
