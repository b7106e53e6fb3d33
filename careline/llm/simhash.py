"""SimHash near-duplicates over an inverted index of byte positions."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from careline.llm.common import folded_words, unused, utf8, written
from careline.llm.components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BYTES = 8
#: Hashes whose bits are counted at once.
CHUNK = 1 << 15
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64 bits; a bit is 1 where more than half of the shingle hashes have it."""
    words = folded_words(text)
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    hashes = map(_hash, map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    total, ones = len(words) - shingle + 1, np.zeros(64, np.int64)
    for start in range(0, total, CHUNK):
        part = np.fromiter(hashes, np.uint64, min(CHUNK, total - start))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, BYTES), axis=1,
                              bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fps = np.array([fingerprint(texts[i].as_py(), shingle) for i in range(len(texts))],
                           np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())],
                                             ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("t"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _mask(positions: tuple[int, ...]) -> int:
    mask = sum(0xFF << (8 * p) for p in positions)
    return mask - (1 << 64) if mask >> 63 else mask


def meetings(classes: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b, n): distinct fingerprints `fp`, a < b, that meet in n > 0 postings.

    A posting is a set of positions with the bytes there. Differing bits touch at most `max_bits`
    bytes, so a linked pair shares the others, and every set within them. Single positions would put
    1/256 of all rows into a posting; sets of one position less than a linked pair shares leave
    256 ** (max_bits + 1) values for the other bytes and still tell by their number how many are shared.
    They are joined by sorting: the engine sizes postings as the classes they are exploded from, and would
    broadcast dozens of rows for each row it counts.
    """
    sets = list(combinations(range(BYTES), _width(max_bits)))
    posting = F.explode(F.array(*(
        F.struct(F.lit(i).alias("positions"),
                 F.col("fp").bitwiseAND(F.lit(_mask(s))).alias("bytes"))
        for i, s in enumerate(sets)))).alias("p")
    postings = classes.select("fp", posting).select("p.positions", "p.bytes", "fp")
    a = postings.withColumnRenamed("fp", "a").hint("merge")
    b = postings.withColumnRenamed("fp", "b")
    return (a.join(b, ["positions", "bytes"]).filter(F.col("a") < F.col("b"))
            .groupBy("a", "b").agg(F.count("*").alias("n")))


def _width(max_bits: int) -> int:
    if not 0 < max_bits < BYTES:
        raise ValueError("max_bits: 1 to 7")
    return max(1, BYTES - max_bits - 1)


def linked(classes: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b) of distinct fingerprints `fp` that differ in at most `max_bits` bits, a < b.

    A pair that shares at least 8 - max_bits positional bytes meets in every posting of those: the
    tally of meetings keeps pairs that reach this number, and their bits are verified.
    """
    least = comb(BYTES - max_bits, _width(max_bits))
    return (meetings(classes, max_bits)
            .filter((F.col("n") >= least)
                    & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
            .select("a", "b"))


def _named_classes(rows: DataFrame, max_bits: int) -> DataFrame:
    """(fp, first_id, component) of each distinct fingerprint of `rows`."""
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    groups = components(linked(classes.select("fp"), max_bits), "a", "b")
    return classes.join(groups, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component"))


def simhash_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of `docs`.

    `docs` needs doc_id and text; other columns are left alone. component_id is the smallest
    doc_id reachable over links of at most `max_bits` differing bits; rows without id have one
    too, NULL where no row of the group has an id. NULL and empty texts have fingerprint zero and
    link like any other; repeated rows are rows of one group each. An empty table gives none.
    Equal fingerprints are one class from the start, so copies are never paired.
    """
    rows = written(fingerprints(docs, shingle), "fingerprints")
    labelled = _named_classes(rows, max_bits)
    least = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = labelled.join(least, "component").select("fp", "component_id")
    return rows.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def distinct_documents(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of each group of `simhash_groups`, with all columns of `docs`.

    It is the row with the smallest doc_id, those without id last; of several with that id the one with
    the smallest fingerprint, then text, then other columns that have an order. NULL and empty texts are
    one group.
    """
    fp = unused("fp", docs.columns)
    name = unused("id", [*docs.columns, fp])
    columns, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint((t.as_py() or "").encode(), shingle)
                            for t in batch.column(at)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps, pa.int64())],
                                             [*columns, fp])

    rows = written(fingerprints(docs, shingle), "fingerprints")
    labelled = _named_classes(rows, max_bits)
    first = (labelled.groupBy("component").agg(F.min(F.struct(
        F.col("first_id").isNull().alias("unnamed"), "first_id", "fp")).alias("first"))
        .select(F.coalesce(F.col("first.first_id").cast("string"), F.lit("")).alias(name),
                F.col("first.fp").alias(fp)))
    schema = StructType([*docs.schema.fields, StructField(fp, LongType())])
    named = docs.mapInArrow(run, schema).withColumn(
        name, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    ordered = ["text", *[f.name for f in docs.schema.fields if f.name != "text"
                         and not re.search(r"\b(map|variant)\b", f.dataType.simpleString())]]
    return (named.join(first, [name, fp])
            .groupBy(name, fp).agg(F.min_by(F.struct(*columns), F.struct(*ordered)).alias("row"))
            .select(*[F.col("row")[c].alias(c) for c in columns]))
