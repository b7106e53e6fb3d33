import math

import pytest

from careline.llm.oracle import oracle_sql
from careline.llm.queries import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "pages"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    want = db.execute(oracle_sql()[name]).df()
    got = queries()[name](spark, SMALL).toPandas()
    assert sorted(got.columns) == sorted(want.columns)

    def rows(frame):
        return sorted((tuple(None if isinstance(v, float) and math.isnan(v) or v is None or str(v) == "<NA>"
                             else str(int(v)) if isinstance(v, float) else str(v) for v in r)
                       for r in frame[sorted(want.columns)].itertuples(index=False)), key=str)
    assert rows(got) == rows(want)
