"""Every registered query equals its SQL on the smallest tables."""

import pytest

from conftest import TESTDATA

import __spark_entry__ as contract
from careline.plans.registry import queries
from oracle.check import compare, connect
from oracle.sql import oracle_sql

FOLDER = str(TESTDATA / "sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())
    assert set(queries()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    problems, _ = compare(queries()[name](spark, FOLDER), oracle_sql()[name], con)
    assert problems == []


def test_entry(spark):
    assert contract.entry(spark).count() > 0
