"""Pipeline from raw documents to piece ids: each stage calls one text operator.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return
the columns of docs. No stage writes; `run` writes what a stage returns to the shared folder and gives
the next one the table. SQL cannot express the stages, so they are tested against brute force.

Rows whose text is NULL or empty go through every stage like others. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careline.llm import decontaminate, pieces, quality, secrets, simhash
from careline.llm.common import fold_of, table, written
from careline.llm.queries import model_file
from careline.llm.sample import labelled_sample

#: A document stays from this score on.
LEAST_QUALITY = 0.3

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.train(labelled_sample(
        docs, table(spark, sf_dir, "labels"), "quality",
        fold_of(F.col("doc_id"), 5) != 0, max_rows=40_000))
    return quality.keep(docs, model, LEAST_QUALITY)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: that with the smallest id, of repeated rows one."""
    return simhash.distinct_documents(docs, shingle=3, max_bits=2)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words lies in benchmark windows go, row by row."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), window=13)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, with their secrets replaced."""
    return secrets.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_ids, round_trip) of every document."""
    return pieces.encode(docs, model_file())


STAGES: list[tuple[str, Stage]] = [
    ("quality", filter_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("pieces", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents table."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
