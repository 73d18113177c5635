"""Job reports and sampled updates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def job_stats(
    jobs: DataFrame, runs: DataFrame, job_key: str, status: str, started: str, ended: str
) -> DataFrame:
    """Jobs with run counts by status, last start and mean seconds; jobs without runs stay.

    Runs are reduced to one row per job before the join, so a job with very many runs is no hot
    join key.
    """
    seconds = (F.unix_micros(F.col(ended).cast("timestamp")) - F.unix_micros(F.col(started).cast("timestamp"))) / F.lit(
        1_000_000.0
    )
    per_job = runs.groupBy(job_key).agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(F.col(status) == "succeeded").alias("successful_runs"),
        F.count_if(F.col(status) == "failed").alias("failed_runs"),
        F.max(started).alias("last_run"),
        F.avg(seconds).alias("avg_duration_seconds"),
    )
    zeros = ["total_runs", "successful_runs", "failed_runs"]
    return jobs.join(per_job, job_key, "left").fillna(0, subset=zeros)


def update_picked(df: DataFrame, picked: DataFrame, key: str, changes: Mapping[str, Column]) -> DataFrame:
    """All rows, with ``changes`` applied to those whose key is in ``picked``.

    ``changes`` may refer to the old values of the row.
    """
    marks = picked.select(F.col(key).alias("__picked")).distinct()
    joined = df.join(marks, F.col(key) == F.col("__picked"), "left")
    hit = F.col("__picked").isNotNull()
    made = {c: F.when(hit, value).otherwise(F.col(c)) for c, value in changes.items()}
    return joined.withColumns(made).drop("__picked")


def picked_rows(df: DataFrame, picked: DataFrame, key: str) -> DataFrame:
    return df.join(picked.select(key).distinct(), key, "left_semi")
