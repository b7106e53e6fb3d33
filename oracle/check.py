"""Compare every query with its SQL on the tables of one folder.

    python -m oracle.check /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import hashlib
import importlib
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parent.parent
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
         "timestamp": "TIMESTAMP"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def fingerprint(frame: pd.DataFrame) -> str:
    """Order-independent hash of the rows, columns by name."""
    frame = frame[sorted(frame.columns)]
    columns = []
    for name in frame.columns:
        c = frame[name]
        if pd.api.types.is_float_dtype(c):
            c = c.map(lambda v: "null" if v is None or v != v else repr(float(v) + 0.0))
        elif pd.api.types.is_datetime64_any_dtype(c):
            c = c.map(lambda v: "null" if pd.isna(v) else pd.Timestamp(v).isoformat())
        else:
            c = c.map(lambda v: "null" if v is None or v is pd.NA or v != v else str(v))
        columns.append(c.astype(str))
    rows = sorted("|".join(r) for r in zip(*columns)) if columns else []
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()


def compare(spark_frame, sql: str, con) -> tuple[list[str], int]:
    problems = []
    relation = con.sql(sql)
    expected_types = {c: str(t) for c, t in zip(relation.columns, relation.types)}
    actual_types = {c: TYPES.get(t, t) for c, t in spark_frame.dtypes}
    if expected_types != actual_types:
        names = set(expected_types) | set(actual_types)
        problems.append("types " + str({n: (actual_types.get(n), expected_types.get(n))
                                        for n in sorted(names)
                                        if actual_types.get(n) != expected_types.get(n)}))
    expected, actual = relation.df(), spark_frame.toPandas()
    for c, t in expected_types.items():
        # nullable integers arrive as floats in pandas
        if t in ("BIGINT", "INTEGER"):
            expected[c] = expected[c].astype("Int64")
            if c in actual:
                actual[c] = actual[c].astype("Int64")
    if len(expected) != len(actual):
        problems.append(f"rows spark={len(actual)} sql={len(expected)}")
    elif set(expected.columns) == set(actual.columns) and fingerprint(expected) != fingerprint(actual):
        problems.append("values")
    return problems, len(actual)


def main() -> int:
    sys.path.insert(0, str(ROOT))
    from careline.session import build_session

    entry = importlib.import_module("__spark_entry__")
    sf_dir, chosen = sys.argv[1], set(sys.argv[2:])
    spark = build_session(master="local[8]", shuffle_partitions=8, extra_conf={
        "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracle, failed = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if chosen and name not in chosen:
            continue
        started = time.time()
        if name not in oracle:
            continue
        try:
            problems, n = compare(query(spark, sf_dir), oracle[name], con)
        except Exception as error:  # noqa: BLE001 - report and go on
            problems, n = [f"{type(error).__name__}: {str(error)[:600]}"], -1
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok':4} {name} rows={n} {time.time() - started:.1f}s "
              + "; ".join(problems), flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
