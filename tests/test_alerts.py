"""Alert rules against a plain evaluation at every step."""

import datetime as dt
import random

import pytest

from driftline.operators.metrics import STAGE_LATENCY_BOUNDS
from driftline.plans import alerts

START = 1704067200
STEP = 30


def make_samples(seed):
    rng = random.Random(seed)
    out = []
    for series in ("a", "b"):
        at = 0.0
        bad = False
        for _ in range(160):
            at += rng.choice([5, 20, 45, 200])
            if rng.random() < 0.08:
                bad = not bad
            base = START + at

            def put(metric, value, outcome="success"):
                out.append((metric, series, outcome, base, float(value)))

            put("cdc_lag_seconds", rng.choice([400, 70]) if bad else 3)
            put("checkpoint_lag_seconds", 121 if bad else 120)
            put("memory_usage_bytes", (7.8 if bad else 6.0) * alerts.GIB)
            put("active_sync_tasks", 0 if bad or rng.random() < 0.3 else 2)
            put("processing_latency_seconds", rng.choice([0.2, 3.0]) if bad else 0.03)
            put("cdc_events_total", 10)
            put("documents_synced_total", 3, "failed" if bad else "success")
            if bad:
                put("cdc_events_failed_total", 1)
                put("dead_letter_events_total", 2)
    return out


def level(points, t):
    seen = [p for p in points if step_of(p[3]) <= t]
    return max(seen, key=lambda p: (p[3], p[4]))[4] if seen else None


def step_of(seconds):
    return (int(seconds // STEP) + 1) * STEP


def quantile(values, q):
    if not values:
        return None
    rank, low, before = q * len(values), 0.0, 0
    for b in STAGE_LATENCY_BOUNDS:
        n = sum(v <= b for v in values)
        if n >= rank:
            return low + (b - low) * (rank - before) / (n - before) if n > before else b
        low, before = b, n
    return STAGE_LATENCY_BOUNDS[-1]


def value_at(rule, samples, t):
    def window(metric, outcome=None):
        return [p for p in samples if p[0] == metric and t - rule.window < step_of(p[3]) <= t and outcome in (None, p[2])]

    if rule.signal == "gauge":
        v = level([p for p in samples if p[0] == rule.metric], t)
        return None if v is None else v / rule.scale
    if rule.signal == "gauge_sum":
        parts = [level([p for p in samples if p[0] == rule.metric and p[1] == s], t) for s in ("a", "b")]
        parts = [p for p in parts if p is not None]
        return sum(parts) if parts else None
    if rule.signal == "rate":
        return sum(p[4] for p in window(rule.metric)) / rule.window
    if rule.signal == "ratio":
        total = sum(p[4] for p in window(rule.base_metric))
        return sum(p[4] for p in window(rule.metric, rule.outcome)) / total if total else None
    return quantile([p[4] for p in window(rule.metric)], rule.quantile)


def brute(rule, samples):
    samples = [p for p in samples if p[0] in (rule.metric, rule.base_metric)]
    found = []
    for series in ("a", "b") if rule.per_series else ("",):
        own = [p for p in samples if p[1] == series or not rule.per_series]
        if not own:
            continue
        first, last = min(step_of(p[3]) for p in own), max(step_of(p[3]) for p in own)
        if rule.signal not in ("gauge", "gauge_sum"):
            last += rule.window
        since = until = None
        for t in range(first, last + STEP, STEP):
            v = value_at(rule, own, t)
            on = v is not None and {">": v > rule.threshold, "<": v < rule.threshold, "=": v == rule.threshold}[rule.op]
            if on:
                since, until = (t, t) if since is None else (since, t)
            if since is not None and (not on or t == last):
                if until - since >= rule.hold_seconds:
                    found.append((rule.name, series, since, until))
                since = None
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_rules(spark, seed):
    samples = make_samples(seed)
    rows = [(m, s, o, dt.datetime.fromtimestamp(t, dt.UTC).replace(tzinfo=None), v) for m, s, o, t, v in samples]
    df = spark.createDataFrame(rows, alerts.SAMPLE_SCHEMA).repartition(3)
    got = sorted((r.alert, r.series, r.since, r.until) for r in alerts.evaluate(df).collect())
    want = sorted(x for rule in alerts.RULES for x in brute(rule, samples))
    assert got == want
    assert len({x[0] for x in want}) >= 8


def test_rules_have_distinct_names():
    assert len({r.name for r in alerts.RULES}) == len(alerts.RULES) == 17
