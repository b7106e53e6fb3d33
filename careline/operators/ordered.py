"""Looking back in an ordered group, without one task per group.

A window puts a whole group into one task. Here rows go to slices of the order (keys, order), which may
cut a key or a day, and a window sees a key's rows of one slice. The borders of the slices are rows of
the table itself, picked from a sample of bounded size, so what a slice has to know of the slice before
it is known before the rows are exchanged: they are exchanged once, and nothing is written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from careline.functions.semantics import order_key, repeated, sort_columns

#: Sampled rows per slice. The sample is what the driver sees.
SAMPLED = 16


class Borders:
    """Rows that end the slices, ascending, and rows with so many copies that they would fill slices."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str],
                 carried: list[str] | tuple[str, ...] = ()) -> None:
        self.keys, self.order = keys, order
        names = list(dict.fromkeys([*keys, *order, *carried]))
        self.types = {f.name: f.dataType for f in df.schema.fields}
        slices = _slices(df.sparkSession)
        sample = _sample(df.select(*names), slices * SAMPLED, [*keys, *order])
        self.frequent: list[Row] = []
        while True:
            places = sorted({len(sample) * i // slices for i in range(1, slices)} - {len(sample)})
            borders = [sample[i] for i in places]
            twice = [a for a, b in zip(borders, borders[1:]) if self._id(a) == self._id(b)]
            if not twice:
                break
            ids = {self._id(r): r for r in twice}
            self.frequent += ids.values()
            sample = [r for r in sample if self._id(r) not in ids]
        self.rows = borders

    def _id(self, row: Row) -> tuple:
        return tuple(str(row[c]) for c in dict.fromkeys([*self.keys, *self.order]))

    def _value(self, row: Row, name: str) -> Column:
        value = row[name]
        if isinstance(self.types[name], TimestampNTZType) and value is not None:
            value = value.isoformat(" ")  # as text it has no time zone on any way
        return F.lit(value).cast(self.types[name])

    def _key(self, row: Row) -> Column:
        parts = []
        for i, c in enumerate([*self.keys, *self.order]):
            value = self._value(row, c)
            parts += [value.isNull().alias(f"n{i}"), value.alias(f"v{i}")]
        return F.struct(*parts)

    def slice(self) -> Column:
        """How many borders lie before a row, by binary search."""
        if not self.rows:
            return F.lit(0)
        borders = F.array(*[self._key(r) for r in self.rows])
        steps = [1 << i for i in reversed(range(len(self.rows).bit_length()))]
        row = order_key(*self.keys, *self.order)
        return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(
            F.try_element_at(borders, at + step) < row, at + step).otherwise(at))

    def is_frequent(self) -> Column:
        row = order_key(*self.keys, *self.order)
        return F.array_contains(F.array(*[self._key(r) for r in self.frequent]), row)

    def before(self, slice_: Column, names: list[str]) -> Column:
        """Keys and the named values of the last row before a slice; NULL for the first slice."""
        if not self.rows:
            return F.lit(None)
        last = [F.struct(*[self._value(r, c).alias(f"k{i}") for i, c in enumerate(self.keys)],
                         *[self._value(r, c).alias(f"v{i}") for i, c in enumerate(names)])
                for r in self.rows]
        return F.when(slice_ > 0, F.try_element_at(F.array(*last), slice_))

    def of_a_border(self) -> Column:
        """Whether the key of a row is that of a border, so that slices may cut it."""
        keys = {tuple(str(r[c]) for c in self.keys): r for r in self.rows}
        found = F.lit(False)
        if keys:
            cut = F.array(*[F.struct(*[self._value(r, c).alias(c) for c in self.keys])
                            for r in keys.values()])
            found = F.array_contains(cut, F.struct(*self.keys))
        return found


def _slices(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _sample(rows: DataFrame, size: int, order: list[str]) -> list[Row]:
    """At most `size` random rows, in order; each task sends that many at most."""
    draws = rows.withColumn("__draw", F.rand(7))
    return (draws.groupBy((F.col("__draw") * size).cast("int").alias("__place"))
            .agg(F.min_by(F.struct(*rows.columns), "__draw").alias("row"))
            .select("row.*").orderBy(*sort_columns(*order)).collect())


def sliced(df: DataFrame, keys: list[str], order: list[str],
           borders: Borders | None = None) -> DataFrame:
    """The rows with `__slice`, ascending along (keys, order), and `__copies`.

    About `spark.sql.shuffle.partitions` slices of equal size. Of a row with so many copies that they would
    fill slices of their own there is one row with their number; all others have one copy each.
    """
    borders = borders or Borders(df, keys, order)
    rows = df.withColumn("__copies", F.lit(1).cast("long"))
    if borders.frequent:
        counted = (df.filter(borders.is_frequent()).groupBy(*df.columns)
                   .agg(F.count(F.lit(1)).alias("__copies")))
        rows = rows.filter(~borders.is_frequent()).unionByName(counted)
    return rows.withColumn("__slice", borders.slice())


def with_previous(df: DataFrame, keys: list[str], order: list[str],
                  previous: dict[str, str]) -> DataFrame:
    """Add, for each `new: column` pair, the column's value in the previous row.

    `order` has to make the order total inside a key, but for equal rows. The first row of a key gets NULL.
    A row that ends a slice is known from the sample, with the values the next slice has to see; a repeated
    task that meets its rows in another order gives the same rows.
    """
    names = list(previous.values())
    borders = Borders(df, keys, order, names)
    rows = sliced(df, keys, order, borders)
    within = Window.partitionBy("__slice", *keys).orderBy(*sort_columns(*order))
    own = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(names)])
    handed = borders.before(F.col("__slice"), names)
    looked = rows.withColumn("__before", F.lag(own).over(within)).withColumn("__handed", handed)
    if borders.rows:
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__handed.k{i}"))
                                           for i, c in enumerate(keys)], F.col("__handed").isNotNull())
        found = [F.when(F.col("__before").isNotNull(), F.col(f"__before.v{i}"))
                 .when(same, F.col(f"__handed.v{i}")) for i in range(len(names))]
    else:
        found = [F.col(f"__before.v{i}") for i in range(len(names))]
    result = looked.select(*df.columns, "__copies",
                           *[c.alias(new) for c, new in zip(found, previous, strict=True)])
    if borders.frequent:
        single = result.filter("__copies = 1").drop("__copies")
        return single.unionByName(_copied(result.filter("__copies > 1"), previous))
    return result.drop("__copies")


def _copied(rows: DataFrame, previous: dict[str, str]) -> DataFrame:
    """Each row as often as it was there; from the second on, the previous row is a copy."""
    one = repeated(rows, "__copies")
    return one.withColumns({new: F.when(F.col("__copy") == 0, F.col(new)).otherwise(F.col(c))
                            for new, c in previous.items()}).drop("__copy")


def with_running_max(df: DataFrame, keys: list[str], order: list[str], new: str,
                     value: Column) -> DataFrame:
    """Add the largest `value` of the rows before a row, of its key; NULL where there is none.

    Rows that are equal in `order` may come in either order, so `value` has to be NULL or equal there.
    Inside a slice a window finds it. The largest values of the slices of a key that is cut are
    handed on from slice to slice: for each border that is one row, joined back by broadcast.
    """
    borders = Borders(df, keys, order)
    rows = df.withColumn("__value", value).withColumn("__slice", borders.slice())
    within = (Window.partitionBy("__slice", *keys).orderBy(*sort_columns(*order))
              .rowsBetween(Window.unboundedPreceding, -1))
    inside = rows.withColumn("__inside", F.max("__value").over(within))
    upto = (Window.partitionBy(*keys).orderBy("__slice")
            .rowsBetween(Window.unboundedPreceding, -1))
    # at most two rows a border: a key that is cut has rows in the slices between its borders
    handed = (rows.filter(borders.of_a_border()).groupBy("__slice", *keys)
              .agg(F.max("__value").alias("__top"))
              .withColumn("__handed", F.max("__top").over(upto)).drop("__top"))
    renamed = {"__slice": "__r_slice"} | {c: f"__r{i}" for i, c in enumerate(keys)}
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(r)) for c, r in renamed.items()])
    return (inside.join(F.broadcast(handed.withColumnsRenamed(renamed)), on, "left")
            .withColumn(new, F.greatest("__inside", "__handed"))
            .select(*df.columns, new))
