"""Helpers shared by the text operators: shipping, scratch tables, byte-level words, hold-out."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careline.session import shared_folder, write_once

# Executors need no copy of the package: functions travel with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A-Z to a-z on UTF-8 bytes; bytes of other characters stay as they are.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: The same, with every ASCII byte that is neither letter nor digit made a space.
ALNUM = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER)


def folded_words(text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of the text, A-Z in lower case."""
    return text.translate(LOWER).split()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read from there.

    Cuts the lineage: a lost executor costs a re-read, not a re-computation, and
    what is computed without a fixed order stays as it was computed first.
    """
    path = scratch_path(df.sparkSession, name)
    write_once(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(name: str, columns: list[str]) -> str:
    """The name, with as many underscores before it as it takes to be none of the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def utf8(text: Column) -> Column:
    """UTF-8 bytes of a text; of NULL, none."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def fold_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; an id of NULL counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
