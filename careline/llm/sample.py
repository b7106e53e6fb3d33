"""Labelled rows to learn from: a bounded, repeatable sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careline.llm.common import utf8, written


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column,
                    max_rows: int) -> DataFrame:
    """(doc_id, text, y): whole texts, as UTF-8, of at most `max_rows` labelled documents.

    `learn` is a condition on doc_id. Of the labelled ids that meet it, those with the smallest
    hashes are taken, so the sample doesn't depend on the order of rows. Labels other than 0 and 1 are
    left out; of two labels for one id the larger counts. The ids are at most `max_rows` short rows,
    which is what is broadcast. Of the documents of one id that with the smallest hash of its text is
    taken; tasks reduce their rows before they send them.
    """
    ids = (labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learn)
           .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
           .agg(F.max(label).cast("int").alias("y"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       utf8(F.col("text")).alias("text"))
    one = (rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y")
           .agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least")))
    return written(one.select("doc_id", "least.text", "y"), "labelled")
