"""Progress of tasks: positions, statistics, retention, resume points and states.

Progress rows: id, task_id, position (sortable), created_at, and counters where written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.topk import first_per_key, newest_per_key

# Fixed values.
KEEP_PER_TASK = 10
MAX_TASK_ERRORS = 10
STALE_FAILURE_MINUTES = 5


def latest(df: DataFrame, created: str = "created_at", tiebreak: str = "id") -> DataFrame:
    """The live row of every task in an append-only progress log."""
    return newest_per_key(df, ["task_id"], 1, created, tiebreak)


def overlay(pending: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored rows, with a pending row of the same task taking precedence."""
    both = pending.withColumn("__level", F.lit(0)).unionByName(stored.withColumn("__level", F.lit(1)))
    return first_per_key(both, ["task_id"], [F.col("__level"), F.col("created_at").desc()]).drop("__level")


def keep_recent(df: DataFrame, n: int = KEEP_PER_TASK, created: str = "created_at", tiebreak: str = "id") -> DataFrame:
    return newest_per_key(df, ["task_id"], n, created, tiebreak)


def orphans(progress: DataFrame, active: DataFrame, key: str = "task_id") -> DataFrame:
    """Progress rows whose task is no longer active."""
    return progress.join(active.select(key).distinct(), key, "left_anti")


def resume_points(tasks: DataFrame, progress: DataFrame, position: str = "position") -> DataFrame:
    """Earliest saved position of every source; null where no task of the source has one."""
    saved = progress.select("task_id", position)
    return (
        tasks.select("source_name", "task_id")
        .join(saved, "task_id", "left")
        .groupBy("source_name")
        .agg(
            F.count(F.lit(1)).alias("tasks"),
            F.count(position).alias("tasks_with_progress"),
            F.min(position).alias("resume_from"),
            F.min_by("task_id", F.when(F.col(position).isNotNull(), F.struct(position, "task_id"))).alias("slowest_task"),
        )
    )


def statistics(df: DataFrame, keys: Sequence[str], failed: Column, size: Column, ts: str) -> DataFrame:
    """Processed and failed rows, bytes, last event and success rate."""
    ok = ~F.coalesce(failed, F.lit(False))
    grouped = df.groupBy(*keys).agg(
        F.count_if(ok).alias("events_processed"),
        F.count_if(~ok).alias("events_failed"),
        F.coalesce(F.sum(F.when(ok, size)), F.lit(0)).alias("bytes_processed"),
        F.max(F.when(ok, F.col(ts))).alias("last_event_at"),
    )
    total = F.col("events_processed") + F.col("events_failed")
    rate = F.coalesce(F.try_divide(F.col("events_processed").cast("double"), total), F.lit(0.0))
    return grouped.withColumn("success_rate", rate)


def task_status(log: DataFrame, order: Sequence[str], ts: str, state: str = "state", error: str = "error") -> DataFrame:
    """State of every task from its log; more than ten errors make it failed."""
    newest = F.struct(*order)
    reported = F.max_by(state, F.when(F.col(state).isNotNull(), newest))
    grouped = log.groupBy("task_id").agg(
        reported.alias("__state"),
        F.count(error).alias("error_count"),
        F.max_by(error, F.when(F.col(error).isNotNull(), newest)).alias("last_error"),
        F.max(ts).alias("last_updated"),
    )
    final = F.when(F.col("error_count") > MAX_TASK_ERRORS, "failed").otherwise(F.coalesce("__state", F.lit("idle")))
    return grouped.withColumn("state", final).drop("__state")


def status_summary(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("state") == "running").alias("running"),
        F.count_if(F.col("state") == "failed").alias("failed"),
    )


def stale_failures(status: DataFrame, now: Column, minutes: int = STALE_FAILURE_MINUTES) -> DataFrame:
    """Tasks failed for longer than ``minutes``, with the whole minutes since."""
    late = now - F.col("last_updated") > F.expr(f"INTERVAL '{int(minutes)}' MINUTE")
    since = F.timestamp_diff("MINUTE", F.col("last_updated"), now)
    return status.where((F.col("state") == "failed") & late).withColumn("minutes_failed", since)
