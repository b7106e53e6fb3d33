"""Exact duplicates by distributed radix partitioning on the bytes of whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careline.llm.common import written

#: Bytes that the first round compares, and how many times wider each next round is.
WIDTH, GROWTH = 64, 64


def normalised(text: Column) -> Column:
    """Bytes of the text with each run of white space made one space; of NULL, none."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+",
                            " ").cast("binary")


def _from(column: str, at: int) -> Column:
    """The bytes of a column from byte number `at`, counted from 0, on."""
    return F.expr(f"substring({column}, {at + 1})")


def exact_groups(docs: DataFrame, width: int = WIDTH, growth: int = GROWTH) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of `docs`.

    Texts are equal when `normalised` gives equal bytes. Most significant digits first: a round splits
    every group by its next bytes, `width` of them in the first round and `growth` times as many in
    each next one. A group is its own key, so only rows whose bytes agreed so far meet again; rows left
    alone are done. Length goes before the first byte, so all texts of a group end in the same
    round, and a group that got there agrees in every byte: equality needs no digest (the one in the
    result is only reported). A group's rows are counted where they lie before anything is sent, and
    a round's groups are written, so that the engine can split the rows of a hot group in the join. The
    join is by sorting at every size: the groups grow with the table, and so may not be broadcast.

    Of equal texts the row with the smallest doc_id is kept; one without id only if no row of the group
    has an id; of several with that id one. NULL and empty texts are equal. Texts of any length are
    compared to their end, in a number of rounds that grows with the logarithm of the longest repeated
    one. Other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        normalised(F.col("text")).alias("t"))
    texts = texts.withColumns({"n": F.octet_length("t"), "head": F.substring("t", 1, width)})
    groups = written(texts.groupBy("n", "head").count().filter("count > 1")
                     .select("n", "head", F.monotonically_increasing_id().alias("name")), "groups")
    at, next_width = width, width * growth
    repeated = F.col("name").isNotNull()
    rows = written(
        texts.join(groups.hint("merge"), ["n", "head"], "left").select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "n", "name",
            F.sha2("t", 256).alias("text_sha256"),
            F.when(repeated, F.expr(f"substring(t, {at + 1}, {next_width})")).alias("head"),
            F.when(repeated, _from("t", at + next_width)).alias("rest")), "digits")
    result = rows.filter(~repeated).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    active = rows.filter(repeated)
    while not active.isEmpty():
        at, next_width = at + next_width, next_width * growth
        first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
        groups = written(
            active.groupBy("name", "head").agg(F.count("*").alias("size"), first.alias("first"))
            .filter("size > 1")
            .withColumn("next_name", F.monotonically_increasing_id()), "groups")
        shared = F.col("next_name").isNotNull()
        going_on = shared & (F.col("n") > at)
        split = written(
            active.join(groups.hint("merge"), ["name", "head"], "left").select(
                "row", "doc_id", "n", "text_sha256",
                F.when(going_on, F.col("next_name")).alias("name"),
                F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
                F.when(shared, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("keep_id"),
                F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"),
                F.when(going_on, F.substring("rest", 1, next_width)).alias("head"),
                F.when(going_on, _from("rest", next_width)).alias("rest")), "digits")
        result = result.unionByName(split.filter(~repeated).select(*result.columns))
        active = split.filter(repeated).drop("group_size", "keep_id", "kept")
    return result
