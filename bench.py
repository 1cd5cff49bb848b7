"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the number of local threads. Every query
runs once on the smallest tables to warm the JVM, then once, timed, on the given ones.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from pulsegrid.plans import catalog  # noqa: E402
from pulsegrid.plans.fixtures import table  # noqa: E402

WARM_DIR = "/root/testdata/sf0.001"
MEMORY = "8g"

# Stage of the work -> (queries, table whose rows they read).
STAGES = {
    "parse": (["parse_json_lines", "parse_logfmt_lines", "parse_plaintext_lines"], "events"),
    "parse_text": (["parse_document_lines", "message_fingerprints"], "documents"),
    "observe": (["observations", "error_patterns"], "events"),
    "detect": (["error_rate_spikes", "latency_spikes", "sustained_elevations", "novel_errors", "cascades"], "events"),
    "end_to_end": (["alert_rows", "alert_table"], "events"),
    "serve": (["dashboard_summary", "delivery_queue", "audit_statistics", "request_latency_ranks"], "events"),
}


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    if name == "alert_table":  # detected and written once; the serving queries read it
        catalog.stored_alerts(spark, sf_dir)
        return time.perf_counter() - start
    catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("pulsegrid-bench")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", MEMORY)
        .config("spark.sql.shuffle.partitions", str(cpus)).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for stage, _ in STAGES.values() for n in stage]
    for name in names:
        run(spark, name, WARM_DIR)
    seconds = {name: round(run(spark, name, sf_dir), 3) for name in names}
    rows = {t: table(spark, sf_dir, t).count() for t in ("events", "documents")}
    rate = {
        stage: round(rows[t] * len(of) / sum(seconds[n] for n in of)) for stage, (of, t) in STAGES.items()
    }
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "rows_per_sec": rate, "cpus": cpus, "memory": MEMORY,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
