"""Failed rows: entries, selection, statistics, triage and retention.

Entry columns: id, task_id, event (JSON text), error, retry_count, created_at, last_retry_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.errors import error_class, error_label
from driftline.operators.topk import keep_newest, oldest_per_key

ENTRY_SCHEMA = (
    "id string, task_id string, event string, error string, retry_count int,"
    " created_at timestamp_ntz, last_retry_at timestamp_ntz"
)
ENTRY_COLUMNS = [c.strip().split(" ")[0] for c in ENTRY_SCHEMA.split(",")]

# Defaults of the triage rules.
MAX_CONSECUTIVE_ERRORS = 10
MAX_RETRIES = 3
MAX_NOT_FOUND_RETRIES = 2
MAX_NETWORK_MINUTES = 30
REPROCESS_LIMIT = 100


def entries(
    rejected: DataFrame, task_id: Column, at: Column | None = None, retry_count: int = 0, identity: Column | None = None
) -> DataFrame:
    """Dead-letter entries of rejected rows (``event``, ``error``).

    The id is a digest of task, identity (the event itself by default) and error, so writing the
    same failure twice gives the same entry.
    """
    now = (F.current_timestamp() if at is None else at).cast("timestamp_ntz")
    what = F.col("event") if identity is None else identity
    return rejected.select(
        F.sha2(F.concat_ws("\x1f", task_id, what.cast("string"), F.col("error")), 256).alias("id"),
        task_id.alias("task_id"),
        F.col("event"),
        F.col("error"),
        F.lit(retry_count).alias("retry_count"),
        now.alias("created_at"),
        (now if retry_count > 0 else F.lit(None).cast("timestamp_ntz")).alias("last_retry_at"),
    )


def by_task(df: DataFrame, task_id: str, limit: int | None = None) -> DataFrame:
    """Entries of one task, oldest first when cut."""
    rows = df.where(F.col("task_id") == task_id)
    return rows if limit is None else rows.orderBy("created_at", "id").limit(limit)


def oldest_entries(df: DataFrame, limit: int = REPROCESS_LIMIT) -> DataFrame:
    """The oldest entries of every task."""
    return oldest_per_key(df, ["task_id"], limit, "created_at", "id")


def retry(picked: DataFrame, at: Column) -> DataFrame:
    return picked.withColumns(
        {"retry_count": F.col("retry_count") + 1, "last_retry_at": at.cast("timestamp_ntz")}
    )


def without(df: DataFrame, removed: DataFrame, key: str = "id") -> DataFrame:
    return df.join(removed.select(key).distinct(), key, "left_anti")


def retained(df: DataFrame, max_entries: int, now: Column, hours: int | None = None) -> DataFrame:
    """Entries young enough, then the newest ``max_entries`` of them."""
    if hours is not None:
        df = df.where(F.col("created_at") >= now - F.expr(f"INTERVAL '{int(hours)}' HOUR"))
    return keep_newest(df, max_entries, "created_at", "id")


# --- statistics -----------------------------------------------------------------------------


def statistics(df: DataFrame) -> DataFrame:
    """Entry counts with oldest and newest time: in total, per task and per first error line."""
    labelled = df.select("task_id", error_label(F.col("error")).alias("error_label"), "created_at")
    grouped = labelled.groupingSets([[], ["task_id"], ["error_label"]], "task_id", "error_label").agg(
        F.grouping_id().alias("gid"),
        F.count(F.lit(1)).alias("entries"),
        F.min("created_at").alias("oldest"),
        F.max("created_at").alias("newest"),
    )
    return grouped.select(
        F.when(F.col("gid") == 3, "total").when(F.col("gid") == 1, "task").otherwise("error").alias("scope"),
        F.coalesce("task_id", "error_label", F.lit("")).alias("name"),
        "entries",
        "oldest",
        "newest",
    )


def counts_by_task(df: DataFrame) -> DataFrame:
    return df.groupBy("task_id").agg(F.count(F.lit(1)).alias("entries"))


def task_list(df: DataFrame) -> DataFrame:
    return df.select("task_id").distinct().orderBy("task_id")


# --- triage ---------------------------------------------------------------------------------


def triage_action(kind: Column, retry_count: Column, consecutive: Column, first: Column, last: Column) -> Column:
    """retry, dead_letter, skip or pause for an error of class ``kind``."""
    too_long = last - first > F.expr(f"INTERVAL '{MAX_NETWORK_MINUTES}' MINUTE")
    retry_left = retry_count < MAX_RETRIES
    return (
        F.when(consecutive >= MAX_CONSECUTIVE_ERRORS, "pause")
        .when(kind == "permission", "pause")
        .when(kind == "data_validation", "dead_letter")
        .when(kind == "not_found", F.when(retry_count < MAX_NOT_FOUND_RETRIES, "retry").otherwise("skip"))
        .when(kind == "rate_limit", "retry")
        .when(retry_left, "retry")
        .when(kind.isin("network", "timeout") & too_long, "pause")
        .otherwise("dead_letter")
    )


def with_error_class(df: DataFrame) -> DataFrame:
    return df.withColumn("error_class", error_class(F.col("error")))


def totals_by_class(df: DataFrame) -> DataFrame:
    return df.groupBy("task_id", "error_class").agg(F.count(F.lit(1)).alias("errors"))
