"""Time the registered queries: one JSON line.

BENCH_SF_DIR   tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default: all)
BENCH_QUERIES  comma-separated name prefixes (default: the headline list; ``all`` for every query)

Each query runs once to warm up and once for the time. Results go to the ``noop`` sink, so
every row is computed and none is sent to the driver.
"""

from __future__ import annotations

import json
import os
import time

# Headline queries: decode, filters and whole tasks, dedup and merge, ordered passes, statistics.
HEADLINE = (
    "a01_full_table_scan",
    "a03_text_line_decode",
    "a04_value_inference",
    "a11_document_ingest",
    "a14_document_size",
    "a15_relation_decode",
    "a17_snapshot_merge",
    "a17_merge_unchanged",
    "a26_dead_letter_retention",
    "b13_conditions_anded",
    "b18_convert_number",
    "b37_task_full_sync",
    "b37_task_changes",
    "c01_index_routing",
    "c02_task_fan_out",
    "c06_job_stats",
    "d01_dead_letter_statistics",
    "d03_dedup_statistics",
    "d05_change_counts",
    "d09_latency_quantiles",
    "d10_failure_ratio",
    "d17_error_triage",
    "e01_last_change_per_key",
    "e02_first_occurrence",
    "e05_rate_5m",
    "e06_moving_average",
    "e07_streaks",
    "e08_all_alert_rules",
    "e09_order_check",
    "f06_batch_cut",
    "h07_position_parse",
    "h10_scalar_decode",
    "h11_array_decode",
    "i02_stateful_dedup",
    "i03_idempotent_apply",
    "i05_streaming_counts",
    "i09_dead_letter_branch",
)


def chosen(names: list[str]) -> list[str]:
    wanted = os.environ.get("BENCH_QUERIES", "")
    if wanted == "all":
        return names
    if wanted:
        return [n for n in names if any(n.startswith(p.strip()) for p in wanted.split(","))]
    return [n for n in HEADLINE if n in names]


def main() -> None:
    from driftline.session import build_session
    from driftline.workload import QUERIES

    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    times = {}
    for name in chosen(list(QUERIES)):
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    events = spark.read.parquet(f"{path}/events.parquet").count()
    merge = times.get("a17_snapshot_merge")
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(path.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "spark": spark.version,
                "merge_events_per_sec": round(events / merge) if merge else None,
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
