import sys
from pathlib import Path

import pytest
from pyspark.sql import Row
from pyspark.sql.types import LongType, StringType, StructField, StructType

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

TEXTS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()),
                    StructField("lang", StringType()), StructField("source", StringType()),
                    StructField("n_chars", LongType()), StructField("score", StringType()),
                    StructField("component_id", StringType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with results."""
    def make(rows):
        return spark.createDataFrame(
            [Row(doc_id=i, text=t, lang=None, source="s", n_chars=len(t or ""), score="x",
                 component_id="y") for i, t in rows], TEXTS).repartition(3)
    return make
