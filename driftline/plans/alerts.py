"""Alert rules over a long sample table, with the condition having to hold for a while.

Samples: ``metric``, ``series`` (labels as one text), ``outcome`` (a label the ratios filter on),
``ts``, ``value``. Gauges carry their level, counters the increment of a sample, latencies the
measured seconds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.operators import metrics
from driftline.session import scratch_path

STEP_SECONDS = 30
SAMPLE_SCHEMA = "metric string, series string, outcome string, ts timestamp_ntz, value double"


@dataclass(frozen=True)
class Rule:
    """``signal`` is gauge, gauge_sum, rate, ratio or quantile; ``op`` one of > < =."""

    name: str
    signal: str
    metric: str
    op: str
    threshold: float
    hold_seconds: int
    severity: str
    window: int = 300
    scale: float = 1.0
    base_metric: str | None = None
    outcome: str | None = None
    quantile: float | None = None
    per_series: bool = True


GIB = 1024.0**3

# Thresholds, windows and hold times of the shipped rules.
RULES = (
    Rule("HighCDCLag", "gauge", "cdc_lag_seconds", ">", 60, 300, "warning"),
    Rule("CriticalCDCLag", "gauge", "cdc_lag_seconds", ">", 300, 120, "critical"),
    Rule("AtLeastOnceDeduplicationFailures", "rate", "at_least_once_violations_total", ">", 0, 60, "critical"),
    Rule("HighCheckpointLag", "gauge", "checkpoint_lag_seconds", ">", 120, 300, "warning"),
    Rule("HighMemoryUsage", "gauge", "memory_usage_bytes", ">", 0.8 * 8, 300, "warning", scale=GIB),
    Rule("CriticalMemoryUsage", "gauge", "memory_usage_bytes", ">", 0.95 * 8, 120, "critical", scale=GIB),
    Rule("ConnectionPoolExhausted", "gauge", "connection_pool_saturation_ratio", ">", 0.9, 300, "critical"),
    Rule("HighProcessingLatency", "quantile", "processing_latency_seconds", ">", 1, 300, "warning", quantile=0.95),
    Rule(
        "HighFailedEventRate", "ratio", "cdc_events_failed_total", ">", 0.01, 300, "warning", base_metric="cdc_events_total"
    ),
    Rule(
        "CriticalFailedEventRate",
        "ratio",
        "cdc_events_failed_total",
        ">",
        0.05,
        120,
        "critical",
        base_metric="cdc_events_total",
    ),
    Rule("HighSyncLag", "gauge", "sync_lag_by_table_seconds", ">", 300, 300, "warning"),
    Rule("DeadLetterQueueGrowing", "rate", "dead_letter_events_total", ">", 0, 600, "warning"),
    Rule("CircuitBreakerOpen", "gauge", "circuit_breaker_state", "=", 1, 60, "critical"),
    Rule("NoActiveSyncTasks", "gauge_sum", "active_sync_tasks", "=", 0, 300, "critical", per_series=False),
    Rule("ReplicationSlotLag", "gauge", "replication_lsn", "=", 0, 300, "warning"),
    Rule(
        "SLOViolationSuccessRate",
        "ratio",
        "documents_synced_total",
        "<",
        0.99,
        300,
        "critical",
        window=1800,
        base_metric="documents_synced_total",
        outcome="success",
        per_series=False,
    ),
    Rule(
        "SLOViolationLatency",
        "quantile",
        "processing_latency_seconds",
        ">",
        1.0,
        300,
        "critical",
        window=1800,
        quantile=0.99,
        per_series=False,
    ),
)


# Points are step functions: a value holds from ``at`` up to the next point of its key. That keeps
# one row per change of a signal instead of one per evaluation step.

EXACT = "decimal(28,6)"


def cells(samples: DataFrame, rules: Sequence[Rule] = RULES, step: int = STEP_SECONDS) -> DataFrame:
    """Samples per metric, series, outcome (where a rule asks for it) and evaluation step: newest level, exact sum
    and bucket counts. All that the rules need of the samples, from one aggregation; what is left is bounded by time.
    """
    timed = F.col("metric").isin(*{r.metric for r in rules if r.signal == "quantile"})
    bounds = metrics.STAGE_LATENCY_BOUNDS
    counts = [F.count_if(timed & (F.col("value") <= F.lit(b))).alias(c) for b, c in zip(bounds, metrics.bucket_columns(bounds))]
    wanted = samples.where(F.col("metric").isin(*{m for r in rules for m in (r.metric, r.base_metric) if m}))
    told_apart = F.col("metric").isin(*{r.metric for r in rules if r.outcome is not None})
    outcome = F.when(told_apart, F.col("outcome")).alias("outcome")
    return wanted.groupBy("metric", "series", outcome, metrics.step_of(F.col("ts"), step).alias("at")).agg(
        F.max(F.struct("ts", "value")).alias("newest"),
        F.coalesce(F.sum(F.col("value").cast(EXACT)), F.lit(0)).cast(EXACT).alias("amount"),
        F.count(F.lit(1)).alias("total"),
        *counts,
    )


def _levels(steps: DataFrame, names: set[str]) -> DataFrame:
    """Gauges: last level of every step that has a sample, from one cell each."""
    return steps.where(F.col("metric").isin(*names)).select("metric", "series", "at", F.col("newest.value").alias("value"))


def _total_level(levels: DataFrame) -> DataFrame:
    """Sum of the levels of all series of a metric, as exact changes added up: sums return to zero."""
    before = F.lag("value", 1).over(W.partitionBy("metric", "series").orderBy("at"))
    change = F.col("value").cast(EXACT) - F.coalesce(before, F.lit(0.0)).cast(EXACT)
    moved = levels.select("metric", "at", change.alias("value")).groupBy("metric", "at").agg(F.sum("value").alias("value"))
    so_far = W.partitionBy("metric").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    return moved.select("metric", F.lit("").alias("series"), "at", F.sum("value").over(so_far).cast("double").alias("value"))


def _expression(rule: Rule) -> tuple:
    """Rules with the same expression are evaluated from one set of points."""
    if rule.signal in ("gauge", "gauge_sum"):
        return (rule.signal,)
    if rule.signal == "rate":
        return (rule.signal, rule.metric, rule.window, rule.per_series)
    return (rule.signal, rule.metric, rule.base_metric, rule.outcome, rule.window, rule.quantile, rule.per_series)


def _trailing(steps: DataFrame, rules: Mapping[int, Rule]) -> DataFrame:
    """Points ``(expression, series, at, value)`` of rates, ratios and quantiles over a trailing window, for all of them at once.

    A cell goes to every expression its metric takes part in: it enters at its step and leaves again a
    window later. Then all expressions share one sum per step and one running sum.
    """
    uses: dict[str, list[Column]] = {}
    for number, rule in rules.items():
        for metric in {rule.metric, rule.base_metric or rule.metric}:
            for shift, sign in ((0, 1), (rule.window, -1)):
                entry = F.struct(
                    F.lit(number).alias("expression"),
                    F.lit(rule.per_series).alias("per_series"),
                    F.lit(metric == rule.metric).alias("part"),
                    F.lit(metric == (rule.base_metric or rule.metric)).alias("base"),
                    F.lit(rule.outcome).cast("string").alias("outcome"),
                    F.lit(rule.signal == "quantile").alias("timed"),
                    F.lit(shift).cast("bigint").alias("shift"),
                    F.lit(sign).alias("sign"),
                )
                uses.setdefault(metric, []).append(entry)
    table = F.create_map(*[c for metric, entries in uses.items() for c in (F.lit(metric), F.array(*entries))])
    rows = steps.where(F.col("metric").isin(*uses)).withColumn("e", F.explode(F.try_element_at(table, F.col("metric"))))
    bounds = metrics.STAGE_LATENCY_BOUNDS
    buckets = [*metrics.bucket_columns(bounds), "total"]
    matches = F.col("e.outcome").isNull() | F.coalesce(F.col("outcome") == F.col("e.outcome"), F.lit(False))
    signed = (F.col("amount") * F.col("e.sign").cast("decimal(1,0)")).cast(EXACT)
    sums = {
        "__part": F.when(F.col("e.part") & matches, signed),
        "__base": F.when(F.col("e.base"), signed),
        **{c: F.when(F.col("e.timed"), F.col(c) * F.col("e.sign")) for c in buckets},
    }
    keys = ["expression", "series"]
    moved = rows.select(
        F.col("e.expression").alias("expression"),
        F.when(F.col("e.per_series"), F.col("series")).otherwise(F.lit("")).alias("series"),
        (F.col("at") + F.col("e.shift")).alias("at"),
        *[c.alias(n) for n, c in sums.items()],
    )
    moved = moved.groupBy(*keys, "at").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in sums])
    so_far = W.partitionBy(*keys).orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    moved = moved.select(*keys, "at", *[F.sum(n).over(so_far).alias(n) for n in sums])
    value = F.lit(None).cast("double")
    for number, rule in rules.items():
        if rule.signal == "rate":
            found = F.col("__base").cast("double") / F.lit(float(rule.window))
        elif rule.signal == "ratio":
            found = F.try_divide(F.col("__part").cast("double"), F.col("__base").cast("double"))
        elif rule.signal == "quantile":
            found = metrics.histogram_quantile(rule.quantile, bounds, [F.col(c) for c in buckets[:-1]], F.col("total"))
        else:
            raise ValueError(f"unknown signal: {rule.signal}")
        value = F.when(F.col("expression") == number, found).otherwise(value)
    return moved.select(*keys, "at", value.alias("value"))


def _rule_rows(rules: Sequence[Rule]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(r.name).alias("alert"),
                F.lit(r.severity).alias("severity"),
                F.lit(r.metric).alias("metric"),
                F.lit(r.op).alias("op"),
                F.lit(float(r.threshold)).alias("threshold"),
                F.lit(r.scale).alias("scale"),
                F.lit(r.hold_seconds).cast("bigint").alias("hold"),
            )
            for r in rules
        ]
    )


def episodes(
    points: DataFrame,
    keys: Sequence[str],
    at: str,
    condition: Column,
    hold_seconds: int | Column,
    last_step: Column | None = None,
) -> DataFrame:
    """Runs of points on which ``condition`` held for at least ``hold_seconds``.

    ``last_step`` is the last moment a point stands for (its own time by default). Points are at
    most one per key and evaluation step, so a key's window is bounded by time, not by rows.
    """
    by_time = W.partitionBy(*keys).orderBy(at)
    rows = points.withColumns({"__on": F.coalesce(condition, F.lit(False)), "__end": F.col(at) if last_step is None else last_step})
    starts = F.col("__on") & ~F.coalesce(F.lag("__on").over(by_time), F.lit(False))
    rows = rows.withColumn("__start", F.when(starts, F.col(at)))
    rows = rows.withColumn("since", F.last("__start", ignorenulls=True).over(by_time)).where("__on")
    runs = rows.groupBy(*keys, "since").agg(F.max("__end").alias("until"), F.count(F.lit(1)).alias("samples"))
    hold = F.lit(hold_seconds) if isinstance(hold_seconds, int) else hold_seconds
    return runs.where(F.col("until") - F.col("since") >= hold)


def evaluate(
    samples: DataFrame, rules: Sequence[Rule] = RULES, step: int = STEP_SECONDS, lookback: int | None = None
) -> DataFrame:
    """Firing episodes of all rules: ``alert, severity, series, since, until, fires_at``.

    The samples are read once; their :func:`cells` are stored and every rule goes on from there. A
    gauge keeps its level until its next sample, or for ``lookback`` seconds at most.
    """
    path = scratch_path(samples.sparkSession, "alert-cells")
    made = cells(samples, rules, step)
    made.write.parquet(path)
    steps = samples.sparkSession.read.schema(made.schema).parquet(path)
    columns = ["rule", "series", "at", "value"]
    parts = []

    def ruled(points: DataFrame, groups: Mapping[object, Sequence[Rule]], name: str) -> DataFrame:
        """A row per point and rule, by what column ``name`` says."""
        table = F.create_map(*[c for key, own in groups.items() for c in (F.lit(key), _rule_rows(own))])
        return points.withColumn("rule", F.explode(F.try_element_at(table, F.col(name)))).select(*columns)

    def by_metric(signal: str) -> dict[str, list[Rule]]:
        found: dict[str, list[Rule]] = {}
        for rule in rules:
            if rule.signal == signal:
                found.setdefault(rule.metric, []).append(rule)
        return found

    gauges, totals = by_metric("gauge"), by_metric("gauge_sum")
    if gauges:
        points = _levels(steps, set(gauges))
        if lookback is not None:
            following = F.lead("at").over(W.partitionBy("metric", "series").orderBy("at"))
            stale = points.withColumn("__next", following).where(F.col("__next").isNull() | (F.col("__next") > F.col("at") + lookback))
            gone = stale.select("metric", "series", (F.col("at") + lookback).alias("at"), F.lit(None).cast("double").alias("value"))
            points = points.unionByName(gone)
        parts.append(ruled(points, gauges, "metric"))
    if totals:
        parts.append(ruled(_total_level(_levels(steps, set(totals))), totals, "metric"))
    expressions: dict[tuple, list[Rule]] = {}
    for rule in rules:
        if rule.signal not in ("gauge", "gauge_sum"):
            expressions.setdefault(_expression(rule), []).append(rule)
    if expressions:
        numbered = dict(enumerate(expressions.values()))
        points = _trailing(steps, {i: own[0] for i, own in numbered.items()})
        parts.append(ruled(points, numbered, "expression"))

    rows = reduce(DataFrame.unionByName, parts).select("series", "at", "value", "rule.*")
    value, limit = F.col("value").cast("double") / F.col("scale"), F.col("threshold")
    test = F.when(F.col("op") == ">", value > limit).when(F.col("op") == "<", value < limit).otherwise(value == limit)
    keys = ["alert", "severity", "hold", "series"]
    # A point stands for the steps up to the next one of its rule and series.
    following = F.lead("at").over(W.partitionBy(*keys).orderBy("at"))
    rows = rows.withColumn("__last", F.coalesce(following - step, F.col("at")))
    found = episodes(rows, keys, "at", test, F.col("hold"), F.col("__last"))
    return found.select("alert", "severity", "series", "since", "until", (F.col("since") + F.col("hold")).alias("fires_at"))
