"""Times the headline queries and prints one JSON line.

The events of the test tables are a single row group, which Spark reads in one task. Before the clock starts they are
written to one file for each core, as a large table would have many files; the queries read that copy.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from riskloom.plans.catalog import catalog  # noqa: E402
from riskloom.session import local_session  # noqa: E402

HEADLINE = (
    "risk_results",
    "end_to_end_results",
    "risk_context",
    "bounded_history",
    "high_risk_alerts",
    "dead_letters",
    "unique_transactions",
    "persistable_events",
    "risk_result_documents",
    "first_write_scores",
)


def run(query, spark, sf_dir) -> float:
    started = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores)
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog()
    given, name = sf_dir, Path(sf_dir).name
    sf_dir = tempfile.mkdtemp(prefix="bench-")
    spark.read.parquet(f"{given}/events.parquet").repartition(cores).write.parquet(f"{sf_dir}/events.parquet")
    run(queries[HEADLINE[0]], spark, sf_dir)  # start executors and compile shared code once
    seconds = {query: round(min(run(queries[query], spark, sf_dir) for _ in range(2)), 3) for query in HEADLINE}
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_second": {name: round(rows / s) for name, s in seconds.items()},
                "sf": name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
