"""How the filters of a corpus interact: removals of every coalition, order and filter."""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careline.llm.common import utf8, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UPPER = bytes(range(65, 91))
CONTINUED = bytes(range(0x80, 0xC0))
SIGNS = re.compile(rb"[#$%&*|]")


def text_failures(text: bytes) -> int:
    """Failed filters of one text as bits: 1 few words, 2 repeated words, 4 capitals, 8 signs."""
    words = text.split()  # at \x20 and \x09 to \x0D
    points = len(text.translate(None, CONTINUED))
    capitals = len(text) - len(text.translate(None, UPPER))
    return ((len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1
            | (100 * capitals > 2 * points) << 2 | bool(SIGNS.search(text)) << 3)


def document_failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, fails), one row for each row of `docs`; fails has a bit a filter, A to E.

    A: under 200 words; B: 100 * distinct words < 50 * words; C: 100 * capitals A-Z > 2 * code points;
    D: one of #$%&*|; E: the text of a smaller doc_id in the whole table is identical. Whole texts
    count; NULL is empty. `part` is the source, NULL the empty text. Rows without id have no
    smaller one and never fail E; of rows that repeat an id none is smaller than the other. Texts
    meet by their SHA-256 on short rows; the first id of each is written, so that the engine can split a
    text that many rows share. Other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fails = pa.array([text_failures(t.as_py()) for t in batch.column(3)], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], fails],
                                             ["doc_id", "part", "digest", "fails"])

    text = utf8(F.col("text"))
    rows = written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("t"))
        .mapInArrow(run, "doc_id long, part string, digest binary, fails int"), "failures")
    first = written(rows.groupBy("digest").agg(F.min("doc_id").alias("first"),
                                               F.count("*").alias("k"))
                    .filter("k > 1").select("digest", "first"), "first-of-text")
    again = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.join(first, "digest", "left").select(
        "doc_id", "part", F.col("fails").bitwiseOR(again.cast("int") * 16).alias("fails"))


def shapley_weights(k: int) -> list[list[int]]:
    """k! times the share of each player in a game, as weights of the values of all 2^k coalitions.

    The shares phi minimise the sum over coalitions S of w(S) (v(S) - sum of phi in S)^2 with
    w(S) = (k-1) / (C(k,|S|) |S| (k-|S|)), under the constraint that they add up to v of all. The normal
    equations with a multiplier for the constraint are solved in rationals for every right side at once;
    the solution is linear in the values, so one matrix serves all games. Row i holds player i.
    """
    inner = range(1, 2 ** k - 1)
    weight = {s: Fraction(k - 1, math.comb(k, b) * b * (k - b))
              for s in inner if (b := s.bit_count())}
    # phi, multiplier | values of all coalitions
    rows = [[sum((w for s, w in weight.items() if s >> i & 1 and s >> j & 1), Fraction(0))
             for j in range(k)] + [Fraction(1)]
            + [weight.get(s, Fraction(0)) * (s >> i & 1) for s in range(2 ** k)]
            for i in range(k)]
    rows.append([Fraction(1)] * k + [Fraction(0)]
                + [Fraction(int(s == 2 ** k - 1)) for s in range(2 ** k)])
    for c in range(k + 1):
        p = next(r for r in range(c, k + 1) if rows[r][c])
        rows[c], rows[p] = rows[p], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(k + 1):
            if r != c and (f := rows[r][c]):
                rows[r] = [x - f * y for x, y in zip(rows[r], rows[c], strict=True)]
    scaled = [[math.factorial(k) * x for x in row[k + 1:]] for row in rows[:k]]
    if any(x.denominator != 1 for row in scaled for x in row):
        raise ArithmeticError("shares of k! orders are whole numbers")
    return [[int(x) for x in row] for row in scaled]


def coalition_removals(failures: DataFrame, k: int, counts: dict[str, Column]) -> DataFrame:
    """(part, coalition, removed, one column a count): what each coalition removes from each part.

    `counts` are conditions on `failures`, counted as they are removed. A coalition is the number whose
    bits are its filters; all 2^k are there for each part. Rows are reduced to at most 2^k cells a
    part where they lie before anything is sent.
    """
    cells = failures.groupBy("part", "fails").agg(
        F.count("*").alias("removed"),
        *[F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(name)
          for name, c in counts.items()])
    names = ["removed", *counts]
    hit = F.col("fails").bitwiseAND(F.col("coalition")) != 0
    return (cells.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit(2 ** k - 1))))
            .groupBy("part", "coalition")
            .agg(*[F.sum(F.when(hit, F.col(n)).otherwise(0)).alias(n) for n in names],
                 F.sum("removed").alias("documents")))


def filter_audit(failures: DataFrame, filters: str, counts: dict[str, Column]) -> DataFrame:
    """One row per part, order of the filters and step: what the step does, and its filter's share.

    `failures` has part and fails, a bit for each letter of `filters`. Columns: part, filter_order, step,
    kept, removed, redundant, unique_fails, `<name>_lost` for each of `counts`, shapley. All are
    differences of coalition removals; shapley is the filter's removals summed over all orders.
    Steps without effect are there with zeros; no rows give none.
    """
    k = len(filters)
    everything = 2 ** k - 1
    spark = failures.sparkSession
    steps = []
    for order in permutations(range(k)):
        before = 0
        for step, i in enumerate(order, 1):
            steps.append(("".join(filters[j] for j in order), step, i, before, before | 1 << i))
            before |= 1 << i
    # k! * k rows, whatever the data
    steps = F.broadcast(spark.createDataFrame(
        steps, "filter_order string, step int, filter int, before int, after int"))
    names = ["removed", *counts]
    games = (coalition_removals(failures, k, counts).groupBy("part")
             .agg(F.array_sort(F.collect_list(F.struct("coalition", *names))).alias("table"),
                  F.max("documents").alias("documents")))

    def value(coalition: Column, name: str = "removed") -> Column:
        return F.element_at("table", coalition + 1)[name]
    shares = [sum((F.lit(w) * value(F.lit(s)) for s, w in enumerate(row) if w), F.lit(0))
              for row in shapley_weights(k)]
    games = games.withColumn("shares", F.array(*shares))
    before, after = F.col("before"), F.col("after")
    alone = after - before
    removed = value(after) - value(before)
    return (games.withColumn("before", F.explode(F.sequence(F.lit(0), F.lit(everything))))
            .join(steps, "before")
            .select("part", "filter_order", "step",
                    (F.col("documents") - value(after)).alias("kept"), removed.alias("removed"),
                    (value(alone) - removed).alias("redundant"),
                    (value(F.lit(everything)) - value(F.lit(everything) - alone))
                    .alias("unique_fails"),
                    *[(value(after, n) - value(before, n)).alias(f"{n}_lost") for n in counts],
                    F.element_at("shares", F.col("filter") + 1).cast("long").alias("shapley")))


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`filter_audit` of the five filters of `document_failures`, with good and toxic documents lost.

    A document is good with label quality 1 and toxic with label toxic 1; of several labels for one id the
    larger counts, documents without label or id are neither. The labels are reduced and written
    first, so that the engine can split a repeated id in the join.
    """
    judged = written(labels.filter("doc_id is not null")
                     .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
                     .agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic")),
                     "judged")
    rows = document_failures(docs).join(judged, "doc_id", "left")
    return filter_audit(rows, "ABCDE", {"good": F.col("good"), "toxic": F.col("toxic")})
