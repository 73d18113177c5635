"""Counts, rates, histograms, quantiles and lag over logs and samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.operators.topk import first_per_key

# Upper bounds of the histograms.
BATCH_SIZE_BOUNDS = (1.0, 5.0, 10.0, 50.0, 100.0, 500.0, 1000.0)
EVENT_LATENCY_BOUNDS = (0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0)
STORE_LATENCY_BOUNDS = (0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0)
STAGE_LATENCY_BOUNDS = (0.0001, 0.0005, 0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
COMMIT_LATENCY_BOUNDS = (0.0001, 0.001, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0)


def change_counts(df: DataFrame, table: str = "table_name", schema: str = "schema_name", op: str = "op") -> DataFrame:
    """Changes per qualified table and operation."""
    return df.groupBy(F.concat_ws(".", schema, table).alias("table"), F.col(op).alias("op")).agg(
        F.count(F.lit(1)).alias("events")
    )


def apply_results(df: DataFrame, index: str, failed: Column, position: str, error: Column) -> DataFrame:
    """Applied and failed rows per index, with the last position written."""
    bad = F.coalesce(failed, F.lit(False))
    return df.groupBy(index).agg(
        F.count_if(~bad).alias("success_count"),
        F.count_if(bad).alias("error_count"),
        F.max(F.when(~bad, F.col(position))).alias("last_position"),
        F.min(F.when(bad, error)).alias("sample_error"),
    )


def apply_errors(df: DataFrame, index: str, failed: Column, error: Column) -> DataFrame:
    """Failed rows per index and error text."""
    return df.where(failed).groupBy(index, error.alias("error")).agg(F.count(F.lit(1)).alias("rows"))


def _long(df: DataFrame, keys: Sequence[str], names: Mapping[str, str], label: str, value: str) -> DataFrame:
    """One row per column of ``names`` (column to label)."""
    items = F.array(
        *[F.struct(F.lit(text).alias("k"), F.col(column).cast("bigint").alias("v")) for column, text in names.items()]
    )
    rows = df.select(*keys, F.explode(items).alias("__item"))
    return rows.select(*keys, F.col("__item.k").alias(label), F.col("__item.v").alias(value))


def field_distribution(df: DataFrame) -> DataFrame:
    """Documents and, per field, documents that hold it; one scan."""
    made = {f"__f{i}": name for i, name in enumerate(df.columns)}
    totals = df.agg(
        F.count(F.lit(1)).alias("number_of_documents"), *[F.count(f"`{n}`").alias(c) for c, n in made.items()]
    )
    return _long(totals, ["number_of_documents"], made, "field", "documents")


def labelled_counts(df: DataFrame, counts: Mapping[str, Column]) -> DataFrame:
    """A report of ``(metric, value)`` rows from one scan; each entry is a condition."""
    made = {f"__m{i}": name for i, name in enumerate(counts)}
    totals = df.agg(*[F.count_if(cond).alias(c) for c, cond in zip(made, counts.values())])
    return _long(totals, [], made, "metric", "value")


# --- histograms -----------------------------------------------------------------------------


def bucket_columns(bounds: Sequence[float]) -> list[str]:
    return [f"le_{i}" for i in range(len(bounds))]


def histogram(df: DataFrame, keys: Sequence[str], value: Column, bounds: Sequence[float]) -> DataFrame:
    """Cumulative counts ``le_0…`` per bound, plus ``count`` and ``sum``. Fixed-size state per key."""
    cells = [F.count_if(value <= F.lit(b)).alias(c) for b, c in zip(bounds, bucket_columns(bounds))]
    return df.groupBy(*keys).agg(
        *cells, F.count(value).alias("count"), F.sum(value.cast("decimal(28,6)")).cast("double").alias("sum")
    )


def histogram_rows(hist: DataFrame, keys: Sequence[str], bounds: Sequence[float]) -> DataFrame:
    """``(le, cumulative)`` rows, ``+Inf`` last, as a metrics endpoint lists them."""
    names = {c: repr(float(b)) for b, c in zip(bounds, bucket_columns(bounds))} | {"count": "+Inf"}
    return _long(hist, keys, names, "le", "cumulative")


def histogram_quantile(q: float, bounds: Sequence[float], cells: Sequence[Column], total: Column) -> Column:
    """Quantile from cumulative counts, linear inside a bucket whose lower end is the bound before.

    Ranks beyond the last bound give that bound; an empty histogram gives null.
    """
    rank = F.lit(q) * total
    result = F.when(total == 0, F.lit(None).cast("double"))
    low, before = 0.0, F.lit(0).cast("bigint")
    for bound, cell in zip(bounds, cells):
        share = (rank - before) / (cell - before).cast("double")
        inside = F.when(cell > before, F.lit(low) + F.lit(bound - low) * share).otherwise(F.lit(bound))
        result = result.when(cell >= rank, inside)
        low, before = bound, cell
    return result.otherwise(F.lit(float(bounds[-1])))


def quantiles(
    df: DataFrame, keys: Sequence[str], value: Column, bounds: Sequence[float], wanted: Mapping[str, float]
) -> DataFrame:
    hist = histogram(df, keys, value, bounds)
    cells = [F.col(c) for c in bucket_columns(bounds)]
    made = [histogram_quantile(q, bounds, cells, F.col("count")).alias(n) for n, q in wanted.items()]
    return hist.select(*keys, "count", *made)


# --- rates ----------------------------------------------------------------------------------


def step_of(ts: Column, step: int) -> Column:
    """Epoch second at which the step holding ``ts`` ends."""
    seconds = F.unix_timestamp(ts)
    return (F.floor(seconds / F.lit(step)) + 1).cast("bigint") * step


def step_sums(df: DataFrame, keys: Sequence[str], ts: str, step: int, sums: Mapping[str, Column]) -> DataFrame:
    """Sums per key and time step: what is left of a hot key is bounded by time, not by its rows."""
    return df.groupBy(*keys, step_of(F.col(ts), step).alias("at")).agg(*[F.sum(c).alias(n) for n, c in sums.items()])


def moving_sums(steps: DataFrame, keys: Sequence[str], sums: Sequence[str], window: int, step: int) -> DataFrame:
    """Sums of the trailing ``window`` seconds at each step. Input has one row per key and step."""
    trailing = W.partitionBy(*keys).orderBy("at").rangeBetween(-(window - step), 0)
    return steps.select(*keys, "at", *[F.sum(c).over(trailing).alias(c) for c in sums])


def moving_rate(
    df: DataFrame, keys: Sequence[str], ts: str, window: int = 300, step: int = 30, amount: Column | None = None
) -> DataFrame:
    """``rate`` per second over the trailing ``window``, at the steps that have samples."""
    steps = step_sums(df, keys, ts, step, {"total": F.lit(1).cast("bigint") if amount is None else amount})
    moved = moving_sums(steps, keys, ["total"], window, step)
    return moved.withColumn("rate", F.col("total") / F.lit(float(window)))


def moving_ratio(
    df: DataFrame, keys: Sequence[str], ts: str, part: Column, window: int = 300, step: int = 30
) -> DataFrame:
    """Share of rows where ``part`` holds, over the trailing ``window``."""
    hit = F.when(part, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    steps = step_sums(df, keys, ts, step, {"part": hit, "total": F.lit(1).cast("bigint")})
    moved = moving_sums(steps, keys, ["part", "total"], window, step)
    return moved.withColumn("ratio", F.col("part") / F.col("total").cast("double"))


# --- lag and batches ------------------------------------------------------------------------


def lag_report(df: DataFrame, keys: Sequence[str], event_ts: str, processed_ts: str) -> DataFrame:
    """Largest and latest seconds between event and processing, per key and (null keys) overall."""
    lag = (F.unix_micros(F.col(processed_ts).cast("timestamp")) - F.unix_micros(F.col(event_ts).cast("timestamp"))) / F.lit(
        1_000_000.0
    )
    rows = df.select(*keys, lag.alias("lag"), F.col(processed_ts).alias("at"))
    return rows.groupingSets([[], list(keys)], *keys).agg(
        F.max("lag").alias("max_lag_seconds"),
        F.max_by("lag", F.struct("at", "lag")).alias("current_lag_seconds"),
        F.count(F.lit(1)).alias("events"),
    )


def batch_report(
    df: DataFrame, table: str, order: Sequence[str], latency_ms: str, throughput: str, size: str, window: int = 10
) -> DataFrame:
    """Last ``window`` batches per table: mean latency (whole ms), mean throughput, current size."""
    recent = first_per_key(df, [table], [F.col(o).desc() for o in order], window)
    return recent.groupBy(table).agg(
        F.floor(F.sum(latency_ms) / F.count(F.lit(1))).cast("bigint").alias("average_latency_ms"),
        F.avg(throughput).alias("average_throughput"),
        F.count(F.lit(1)).alias("metrics_count"),
        F.max_by(size, F.struct(*order)).alias("current_batch_size"),
    )
