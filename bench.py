"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewatch.plans import load_all  # noqa: E402
from tidewatch.session import build_session  # noqa: E402

HEADLINE = [
    "validate_with_defaults",
    "null_check",
    "datatype_check",
    "range_check",
    "dataset_checksum",
    "column_checksums",
    "checksum_check",
    "pk_uniqueness",
    "dup_pk_rows",
    "fk_orphans",
    "fk_check",
    "union_failed_rows",
    "rule_run_all",
    "record_types",
    "profile_columns",
    "profile_top_values",
    "profile_dataset",
    "metrics_daily",
    "metrics_summary",
    "histogram_stats",
    "audit_statistics",
    "failure_patterns",
    "freshness_validate",
    "load_batch",
    "verify_batch",
    "retry_eligibility",
    "retry_timeline",
    "log_batches",
    "schema_register",
    "drift_detect",
    "contract_validate",
    "stream_counters",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load_all()
    spark.read.parquet(f"{folder}/region.parquet").count()
    seconds = {name: timed(spark, queries[name], folder) for name in names}
    # The same queries on a tenth of the data show what grows with it.
    smaller = os.environ.get("BENCH_SMALL_DIR", "/root/testdata/sf0.01")
    small = {n: timed(spark, queries[n], smaller, 1) for n in names} if os.path.isdir(smaller) and smaller != folder else {}
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "smaller": {"sf": smaller.rstrip("/").rsplit("sf", 1)[-1], "value": round(sum(small.values()), 3), "queries": small},
            }
        )
    )
    spark.stop()


def timed(spark, query, folder: str, runs: int = 2) -> float:
    """The best of some runs; every row and column is computed, nothing is kept."""
    best = float("inf")
    for _ in range(runs):
        start = time.perf_counter()
        query(spark, folder).write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - start)
    return round(best, 3)


if __name__ == "__main__":
    main()
