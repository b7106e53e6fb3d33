"""The registered queries of the text operators."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careline.llm import (
    audit,
    collocations,
    decontaminate,
    lattice,
    ngram,
    pieces,
    quality,
    radix,
    ring,
    secrets,
    simhash,
    toxicity,
    warc,
)
from careline.llm.common import fold_of, scratch_path, table

Query = Callable[[SparkSession, str], DataFrame]




def model_file() -> str:
    """The public piece vocabulary; SPM_MODEL names another model file."""
    return os.environ.get("SPM_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def _fold(modulus: int) -> Column:
    return fold_of(F.col("doc_id"), modulus)


def _judged(scores: DataFrame, held: Column, least: float) -> DataFrame:
    return scores.select("doc_id", held.alias("held_out"), "score",
                         (F.col("score") >= least).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                              learn=_fold(3) != 1)
    return _judged(found, _fold(3) == 1, 0.7)


def op2_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"),
                                        table(spark, sf_dir, "benchmark"), window=13)
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        "contaminated")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                             learn=_fold(5) != 0)
    return _judged(scores, _fold(5) == 0, 0.3)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), model_file())


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score_corpus(table(spark, sf_dir, "documents"), learn=_fold(7) != 2)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda s: s["kind"] != "novel")

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(
            f"n_{kind}")

    def listed(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("secrets")).alias("spans"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix.exact_groups(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_toxicity, op2_lattice, op3_sharding, op4_decontamination, op5_quality, op6_pieces,
        op7_lm, op8_warc, op9_simhash, op10_secrets, op11_audit, op12_radix,
        op13_collocations)}
