"""The alert rules as SQL over ``events``, one statement per rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from driftline.operators import metrics
from driftline.plans.alerts import STEP_SECONDS, Rule

EXACT = "DECIMAL(28, 6)"


def _quantile(q: float, bounds: Sequence[float]) -> str:
    """Linear inside the bucket that holds the rank; counts ``c0, c1, …`` are cumulative."""
    cases, low, before = [], 0.0, "0"
    for i, bound in enumerate(bounds):
        share = f"({q} * total - {before}) / CAST(c{i} - {before} AS DOUBLE)"
        inside = f"CASE WHEN c{i} > {before} THEN {low!r}::DOUBLE + {bound - low!r}::DOUBLE * ({share}) ELSE {bound!r}::DOUBLE END"
        cases.append(f"WHEN c{i} >= {q} * total THEN {inside}")
        low, before = bound, f"c{i}"
    return f"CASE WHEN total = 0 THEN NULL {' '.join(cases)} ELSE {bounds[-1]!r}::DOUBLE END"


def _trailing(name: str, wanted: str, series: str, sums: Mapping[str, str], window: int, value: str) -> str:
    """What enters at a step leaves ``window`` later; running sums of both are the trailing sums."""
    steps = ", ".join(f"sum({e}) AS {n}" for n, e in sums.items())
    moved = ", ".join(f"{n} * sign AS {n}" for n in sums)
    running = ", ".join(f"sum(sum({n})) OVER (PARTITION BY series ORDER BY \"at\") AS {n}" for n in sums)
    return f"""{name}_steps AS (SELECT {series} AS series, "at", {steps} FROM samples WHERE {wanted} GROUP BY ALL),
    {name}_moves AS (SELECT series, "at" + late AS "at", {moved} FROM {name}_steps, (VALUES (0, 1), ({window}, -1)) m(late, sign)),
    {name}_sums AS (SELECT series, "at", {running} FROM {name}_moves GROUP BY series, "at"),
    {name}_points AS (SELECT series, "at", {value} AS value FROM {name}_sums)"""


def _points(name: str, rule: Rule) -> str:
    level = f"""SELECT series, "at", arg_max(value, (ts, value)) AS value FROM samples WHERE metric = '{rule.metric}' GROUP BY ALL"""
    if rule.signal == "gauge":
        return f"{name}_points AS ({level})"
    if rule.signal == "gauge_sum":
        change = f"""value::{EXACT} - coalesce(lag(value) OVER (PARTITION BY series ORDER BY "at"), 0)::{EXACT}"""
        return f"""{name}_levels AS ({level}), {name}_moves AS (SELECT "at", {change} AS change FROM {name}_levels),
    {name}_points AS (SELECT '' AS series, "at", sum(sum(change)) OVER (ORDER BY "at") AS value FROM {name}_moves GROUP BY "at")"""
    series = "series" if rule.per_series else "''"
    amount = f"value::{EXACT}"
    if rule.signal == "rate":
        value = f"total::DOUBLE / {rule.window}.0"
        return _trailing(name, f"metric = '{rule.metric}'", series, {"total": amount}, rule.window, value)
    base = rule.base_metric or rule.metric
    if rule.signal == "ratio":
        part = f"metric = '{rule.metric}'" + (f" AND outcome = '{rule.outcome}'" if rule.outcome else "")
        sums = {"part": f"CASE WHEN {part} THEN {amount} ELSE 0 END", "total": f"CASE WHEN metric = '{base}' THEN {amount} ELSE 0 END"}
        value = "part::DOUBLE / nullif(total::DOUBLE, 0)"
        return _trailing(name, f"metric IN ('{rule.metric}', '{base}')", series, sums, rule.window, value)
    bounds = metrics.STAGE_LATENCY_BOUNDS
    sums = {f"c{i}": f"CASE WHEN value <= {b!r}::DOUBLE THEN 1 ELSE 0 END" for i, b in enumerate(bounds)} | {"total": "1"}
    return _trailing(name, f"metric = '{rule.metric}'", series, sums, rule.window, _quantile(rule.quantile, bounds))


def rules_sql(samples: Mapping[str, str], rules: Sequence[Rule]) -> str:
    """``samples`` gives the SQL of each metric's value; null values are no samples."""
    rows = " UNION ALL ".join(f"SELECT '{n}' AS metric, {e} AS value, * EXCLUDE (value) FROM e" for n, e in samples.items())
    parts, results = [], []
    for i, rule in enumerate(rules):
        name = f"r{i}"
        parts.append(_points(name, rule))
        hot = f"coalesce(value::DOUBLE / {rule.scale!r} {rule.op} {float(rule.threshold)!r}, false)"
        parts.append(
            f"""{name}_runs AS (SELECT *, sum(CASE WHEN hot AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY "at") AS run
        FROM (SELECT *, lag(hot) OVER w AS before, coalesce(lead("at") OVER w - {STEP_SECONDS}, "at") AS last
              FROM (SELECT series, "at", {hot} AS hot FROM {name}_points) WINDOW w AS (PARTITION BY series ORDER BY "at")))"""
        )
        results.append(
            f"""SELECT '{rule.name}' AS alert, '{rule.severity}' AS severity, series, min("at") AS since, max(last) AS until,
        min("at") + {rule.hold_seconds} AS fires_at FROM {name}_runs WHERE hot GROUP BY series, run HAVING max(last) - min("at") >= {rule.hold_seconds}"""
        )
    return f"""WITH e AS (SELECT *, value AS v, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_type AS series,
        CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS outcome,
        (CAST(floor(epoch(ts) / {STEP_SECONDS}) AS BIGINT) + 1) * {STEP_SECONDS} AS "at" FROM events),
    samples AS (SELECT metric, series, outcome, ts, "at", value FROM ({rows}) WHERE value IS NOT NULL),
    {", ".join(parts)}
    {" UNION ALL ".join(results)}"""
