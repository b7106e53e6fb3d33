"""NULL handling that differs from Spark's defaults.

The analyses were defined with missing-value rules under which one missing input
makes an aggregate missing, a missing category counts as a category, and a
missing key joins to a missing key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict(aggregate: Column, *inputs: Column | str) -> Column:
    """`aggregate`, or NULL when any row of the group has a NULL input."""
    complete = reduce(lambda a, b: a & b,
                      [F.count(col(x)) == F.count(F.lit(1)) for x in inputs])
    return F.when(complete, aggregate)


def single_valued(*columns: Column | str) -> Column:
    """Whether a group holds one distinct value, NULL counting as a value.

    Compares minimum and maximum, so the state is two values per group however
    many rows the group has, and it is combined on the map side.
    """
    if len(columns) == 1:
        c = col(columns[0])
        return (F.min(c).eqNullSafe(F.max(c))
                & ((F.count(c) == 0) | (F.count(c) == F.count(F.lit(1)))))
    value = F.struct(*[col(c) for c in columns])
    return F.min(value).eqNullSafe(F.max(value))


def is_in(c: Column, values) -> Column:
    """Two-valued membership: NULL is not a member."""
    return F.coalesce(c.isin(*values), F.lit(False))


def order_key(*columns: Column | str) -> Column:
    """Comparable struct that sorts like `columns` ascending with NULLs last."""
    parts = []
    for i, c in enumerate(columns):
        parts += [col(c).isNull().alias(f"n{i}"), col(c).alias(f"v{i}")]
    return F.struct(*parts)


def sort_columns(*columns: Column | str) -> list[Column]:
    return [col(c).asc_nulls_last() for c in columns]


def join_on(left: DataFrame, right: DataFrame, keys: list[str] | list[tuple[str, str]],
            how: str = "inner", condition: Column | None = None) -> DataFrame:
    """Join in which a NULL key matches a NULL key; the right keys are dropped.

    `keys` are names common to both sides or (left, right) pairs.
    """
    pairs = [(k, k) if isinstance(k, str) else k for k in keys]
    renamed = {r: f"__r_{r}" for _, r in pairs}
    right = right.withColumnsRenamed(renamed)
    on = reduce(lambda a, b: a & b,
                [F.col(l).eqNullSafe(F.col(renamed[r])) for l, r in pairs])
    if condition is not None:
        on = on & condition
    joined = left.join(right, on, how)
    return joined.drop(*renamed.values()) if how not in ("left_semi", "left_anti") else joined


def join_apart(left: DataFrame, right: DataFrame, keys: list[str] | list[tuple[str, str]],
               how: str = "inner") -> DataFrame:
    """`join_on` with a hash beside the keys.

    Both sides are then exchanged for the join, also one that lies by its keys already, as an
    aggregate by them does; only then can the engine split a hot key.
    """
    pairs = [(k, k) if isinstance(k, str) else k for k in keys]
    left = left.withColumn("__hash", F.xxhash64(F.lit(0), *[a for a, _ in pairs]))
    right = right.withColumn("__hash", F.xxhash64(F.lit(0), *[b for _, b in pairs]))
    return join_on(left, right, [*pairs, ("__hash", "__hash")], how).drop("__hash")


#: Copies of a row that are written out at once.
REPEATED = 10_000


def repeated(rows: DataFrame, copies: str) -> DataFrame:
    """Each row as often as `copies` says, numbered from 0 in `__copy`, in steps of bounded size."""
    last = F.col(copies) - 1
    steps = rows.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), last,
                                                           F.lit(REPEATED).cast("long"))))
    return steps.withColumn("__copy", F.explode(F.sequence(
        F.col("__copy"), F.least(F.col("__copy") + (REPEATED - 1), last)))).drop(copies)
