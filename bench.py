"""Time the headline queries; prints one JSON line.

Every query runs whole (its result goes to the no-op sink) three times after a warm-up; the time
reported is the mean.  Message queries also report measured message bytes per second.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ferrytrace.plans.catalog import QUERIES
from ferrytrace.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

# Query -> the table whose rows it processes.
HEADLINE = {
    "flagship_delivery": "events",
    "filter_in_list": "events",
    "filter_stats": "events",
    "to_keyed_json": "events",
    "row_to_line": "events",
    "key_from_int": "orders",
    "payload_bytes": "documents",
    "count_rows": "lineitem",
    "gen_readings": "events",
    "gen_json_payload": "events",
    "pack_messages": "events",
    "dense_index": "events",
    "chunk_by_bytes": "events",
    "progress_marks": "events",
    "idle_cutoff": "events",
    "delivery_summary": "events",
    "delivery_from_headers": "events",
    "reconcile_counts": "events",
    "topic_scan_batch": "events",
    "take_target": "events",
    "replicate_mean_std": "lineitem",
    "replicate_cv": "lineitem",
    "compare_engines": "lineitem",
    "pivot_acks": "lineitem",
    "best_config": "lineitem",
    "grid_fill": "lineitem",
    "split_fused_records": "lineitem",
    "log_producer_perf": "events",
    "log_consumer_perf": "events",
    "log_key_values": "events",
    "tail_mean": "events",
    "stream_parse_project": "events",
    "stream_filter_deliver": "events",
    "stream_replicate": "events",
    "stream_chunk_transfer": "events",
    "pipe_remote_filter": "events",
    "pipe_direct": "events",
    "pipe_filter_files": "events",
    "pipe_replicated": "events",
    "pipe_chunked": "events",
    "pipe_packed": "events",
}


def timed(spark, name: str) -> tuple[float, dict | None]:
    """Seconds of one whole run, and the messages and bytes seen passing by, if it makes any."""
    began = time.perf_counter()
    result = QUERIES[name](spark, SF_DIR)
    seen = None
    if "value" in result.columns and result.schema["value"].dataType.simpleString() == "string":
        seen = Observation()
        result = result.observe(
            seen, F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value")).alias("bytes")
        )
    result.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began, seen.get if seen else None


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or list(HEADLINE)
    tables = sorted({HEADLINE[name] for name in chosen})
    rows = {table: spark.read.parquet(f"{SF_DIR}/{table}.parquet").count() for table in tables}
    seconds, details = {}, {}
    for name in chosen:
        timed(spark, name)
        results = [timed(spark, name) for _ in range(RUNS)]
        runs = [duration for duration, _ in results]
        mean = statistics.mean(runs)
        seconds[name] = round(mean, 4)
        details[name] = {
            "std": round(statistics.pstdev(runs), 4),
            "input_rows": rows[HEADLINE[name]],
            "input_rows_per_sec": round(rows[HEADLINE[name]] / mean),
        }
        out = results[-1][1]
        if out:
            details[name]["messages_per_sec"] = round(out["n"] / mean)
            details[name]["mib_per_sec"] = round((out["bytes"] or 0) / 1048576 / mean, 2)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(CPUS),
                "runs": RUNS,
                "details": details,
            }
        )
    )


if __name__ == "__main__":
    main()
