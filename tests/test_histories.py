"""Factorised pairs: linear in a hot key, exact when expanded."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from careline.operators import dispensing as D


@pytest.fixture(scope="module")
def tables(spark):
    """A key with most rows on both sides, copies, NULL keys, a key on either side only."""
    rows = [("hot", "m", i) for i in range(600)] + [("hot", "m", -1)] * 50
    rows += [("a", "m", 1), ("a", "m", 1), ("b", "m", 2), (None, "m", 3), ("c", None, 4)]
    presc = [("hot", "m", f"p{i}", i) for i in range(400)] + [("a", "m", "x", 1), ("a", "m", None, 2),
             (None, "m", "y", 3), ("z", "m", "w", 5), ("a", "m", "x", 1)]
    return (spark.createDataFrame(rows, "nhc string, med_code string, qty int"),
            spark.createDataFrame(presc, "nhc string, med_code string, prescription_id string, dose int"))


@pytest.mark.parametrize("piece", [50, 1000])
def test_expanded_pairs_are_the_join(tables, piece):
    rows, presc = tables
    got = D.expanded_pairs(D.paired_histories(rows, presc, piece))
    want = D.dispensing_prescriptions(rows, presc).select(*got.columns)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_rows_and_lists_grow_with_a_hot_key_and_not_with_its_pairs(tables):
    rows, presc = tables
    found = D.paired_histories(rows, presc, 50).select(
        "nhc", F.coalesce(F.size("dispensings"), F.lit(0)).alias("d"),
        F.coalesce(F.size("prescriptions"), F.lit(0)).alias("p")).collect()
    hot = [r for r in found if r.nhc == "hot"]
    assert 601 / 50 <= len(hot) <= 2 * 601 / 50 + 1
    assert max(r.d for r in found) <= 50 and max(r.p for r in found) <= 50
    assert sum(r.d for r in hot) == 601 and sum(r.p for r in hot) == 400


def test_flags_follow_from_the_factorised_form(tables):
    rows, presc = tables
    got = {(r.nhc, r.med_code): (r.dispensings, r.prescriptions, r.identified, r.pairs, r.matched, r.unmatched)
           for r in D.history_counts(D.paired_histories(rows, presc, 50)).collect()}
    assert got == {("hot", "m"): (650, 400, 400, 260_000, True, False), ("a", "m"): (2, 3, 2, 6, True, True),
                   ("b", "m"): (1, 0, 0, 1, False, True), (None, "m"): (1, 1, 1, 1, True, False),
                   ("c", None): (1, 0, 0, 1, False, True)}


def test_nothing_to_pair(tables):
    rows, presc = tables
    assert D.paired_histories(rows.limit(0), presc).collect() == []
    assert D.expanded_pairs(D.paired_histories(rows.limit(0), presc)).collect() == []
    alone = D.expanded_pairs(D.paired_histories(rows, presc.limit(0)))
    assert alone.count() == rows.count() and alone.filter("prescription_id is not null").count() == 0
