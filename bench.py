"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  folder of the Parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_RUNS    timed runs per query, the median counts (default 2)
BENCH_ALL     1 to time every registered query
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = ["outcome_summary", "process_outcomes", "clean_cohort", "followup_gaps", "trend_fit",
            "dispensing_gaps", "valid_dispensings", "point_in_time_posology", "coverage_summary",
            "cohort_by_drug", "km_curve", "logrank_test", "path_frequency",
            "path_duration_stats", "dose_combinations"]


def main() -> None:
    from careline.plans.registry import queries
    from careline.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session("careline-bench", f"local[{cpus}]", int(cpus), {
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        # the tables given are files of one row group each
        "spark.careline.spreadInput": "true"})
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    names = list(registered) if os.environ.get("BENCH_ALL") == "1" else HEADLINE

    def run(name: str) -> float:
        started = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    seconds = {}
    for name in names:
        run(name)  # warm-up: code generation and file footers
        seconds[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
        print(f"{name}: {seconds[name]} s", file=sys.stderr, flush=True)
    sf = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "total seconds, headline queries", "unit": "sec",
                      "value": round(sum(seconds.values()), 3), "queries": seconds,
                      "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
