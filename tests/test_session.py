import time
from pathlib import Path

from pyspark.sql import functions as F

from careline.session import FREE_SHUFFLES, written


def test_a_written_table_leaves_no_shuffle_files(spark):
    """Its exchanges are deleted with the write, and the setting is as it was."""
    def left():
        return {f for top in Path(spark.conf.get("spark.local.dir", "/tmp")).glob("blockmgr-*")
                for f in top.glob("*/shuffle_*.data")}

    before, setting = left(), spark.conf.get(FREE_SHUFFLES, None)
    rows = written(spark.range(20_000).groupBy((F.col("id") % 5_000).alias("k")).count(), "groups")
    until = time.time() + 10
    while left() - before and time.time() < until:
        time.sleep(0.2)
    assert not left() - before
    assert spark.conf.get(FREE_SHUFFLES, None) == setting
    assert rows.count() == 5_000 and rows.agg(F.sum("count")).first()[0] == 20_000


def test_threads_that_write_at_once_leave_the_setting(spark):
    from concurrent.futures import ThreadPoolExecutor
    setting = spark.conf.get(FREE_SHUFFLES, None)
    with ThreadPoolExecutor(4) as pool:
        counts = list(pool.map(lambda n: written(spark.range(n).repartition(3, "id"), "x").count(), range(1, 9)))
    assert counts == [*range(1, 9)]
    assert spark.conf.get(FREE_SHUFFLES, None) == setting
