"""Repeated deliveries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.topk import first_per_key

# Identity of a delivered change.
DELIVERY_KEY = ("lsn", "xid", "table_name", "pk")


def first_seen(df: DataFrame, keys: Sequence[str], arrival: Sequence[Column]) -> DataFrame:
    """First arrival of every key."""
    return first_per_key(df, keys, arrival, 1)


def dedup_stats(df: DataFrame, keys: Sequence[str], window: int = 10_000) -> DataFrame:
    """One row: deliveries, repeats, keys beyond the window and the repeat rate."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("seen"))
    totals = per_key.agg(
        F.coalesce(F.sum("seen"), F.lit(0)).alias("total_events"), F.count(F.lit(1)).alias("distinct_keys")
    )
    repeats = F.col("total_events") - F.col("distinct_keys")
    rate = F.coalesce(F.try_divide(repeats.cast("double"), F.col("total_events")), F.lit(0.0))
    return totals.select(
        "total_events",
        repeats.alias("duplicate_events"),
        F.greatest(F.lit(0).cast("bigint"), F.col("distinct_keys") - window).alias("window_evictions"),
        rate.alias("duplicate_rate"),
    )


def stream_first_seen(df: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """Streaming variant: keys are remembered until the watermark passes them by ``delay``."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))
