"""Tables in which one order holds a third of the rows, and one row many copies."""

import pytest

from conftest import TESTDATA

import __spark_entry__ as contract
from careline.operators import steps as S
from careline.sources.star import star_table
from oracle.check import compare, connect

QUERIES = ["outcome_summary", "process_outcomes", "clean_cohort", "followup_gaps", "step_changes",
           "dispensing_gaps", "valid_dispensings", "point_in_time_posology", "coverage_ratio",
           "coverage_summary", "naive_patients", "persistence_times", "persistence_counts",
           "km_curve", "treatment_lines", "dose_variants"]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = connect(str(TESTDATA / "sf0.001"))
    for (table,) in con.execute("SELECT view_name FROM duckdb_views() WHERE NOT internal").fetchall():
        text = f"SELECT * FROM {table}"
        if table == "lineitem":
            text = """SELECT * REPLACE (CASE WHEN l_partkey % 3 = 0 THEN 7 ELSE l_orderkey END AS l_orderkey) FROM lineitem
              UNION ALL SELECT l.* REPLACE (7 AS l_orderkey) FROM (SELECT * FROM lineitem ORDER BY ALL LIMIT 1) l, range(300)"""
        con.execute(f"COPY ({text}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_skewed(spark, skewed, name):
    problems, rows = compare(contract.queries()[name](spark, skewed),
                             contract.oracle_sql()[name], connect(skewed))
    assert problems == [] and rows > 0


def test_engine_splits_the_hot_key_in_joins(spark, skewed):
    """With thresholds fit for small data the join back to the steps is split."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
                "spark.sql.adaptive.coalescePartitions.enabled": "false",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    steps = star_table(spark, skewed, "steps").repartition(16)
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        frame = S.step_frame(steps, S.process_table(steps))
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert "SortMergeJoin(skew=true)" in plan


@pytest.mark.parametrize("name", ["km_curve", "logrank_test", "coverage_summary"])
def test_no_window_per_patient_and_no_second_interval_join(spark, skewed, name):
    """The valid dispensings are read as written; windows go by slice, drug or comparison."""
    frame = contract.queries()[name](spark, skewed)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(nhc" not in plan and "__at_slice" not in plan
