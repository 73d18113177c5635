"""Order-dependent queries (section E)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators import dedup, merge, metrics, ordered, progress, topk
from driftline.plans import alerts
from driftline.session import scratch_path
from driftline.workload.alert_sql import rules_sql
from driftline.workload.base import DELIVERIES, LOG, SEGMENT, Tables, query
from driftline.workload.scans import LETTERS, TIED, letters, tied_rows


@query(
    "e01_last_change_per_key",
    f"WITH {LOG} SELECT k, event_id, op, value FROM chg QUALIFY row_number() OVER (PARTITION BY k ORDER BY event_id DESC) = 1",
)
def last_change_per_key(t: Tables) -> DataFrame:
    return merge.latest_per_key(t.log, ["k"], ["event_id"]).select("k", "event_id", "op", "value")


@query(
    "e02_first_occurrence",
    f"""WITH {DELIVERIES} SELECT event_id, k, event_type AS table_name, arrival, value FROM dlv
    QUALIFY row_number() OVER (PARTITION BY event_id, k, event_type ORDER BY arrival) = 1""",
)
def first_occurrence(t: Tables) -> DataFrame:
    rows = t.deliveries.withColumns(
        {"xid": F.lit(None).cast("bigint"), "pk": F.col("k").cast("string"), "table_name": F.col("event_type")}
    )
    first = dedup.first_seen(rows, dedup.DELIVERY_KEY, [F.col("arrival")])
    return first.select("event_id", "k", "table_name", "arrival", "value")


@query(
    "e03_newest_per_task",
    """SELECT user_id AS task_id, event_id AS id, ts AS created_at FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10""",
)
def newest_per_task(t: Tables) -> DataFrame:
    rows = t.events.select(
        F.col("user_id").alias("task_id"), F.col("event_id").alias("id"), F.col("ts").alias("created_at")
    )
    return progress.keep_recent(rows)


@query(
    "e04_oldest_per_task",
    f"WITH {LETTERS} SELECT id, task_id FROM letters QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY created_at, id) <= 5",
)
def oldest_per_task(t: Tables) -> DataFrame:
    from driftline.operators.deadletters import oldest_entries

    return oldest_entries(letters(t), 5).select("id", "task_id")


def _rate_sql(seconds: int) -> str:
    return f"""WITH s AS (SELECT event_type, (CAST(floor(epoch(ts) / 30) AS BIGINT) + 1) * 30 AS "at", count(*) AS n FROM events GROUP BY ALL)
    SELECT event_type, "at", sum(n) OVER w ::BIGINT AS total, round(sum(n) OVER w / {seconds}.0, 9) AS rate FROM s
    WINDOW w AS (PARTITION BY event_type ORDER BY "at" RANGE BETWEEN {seconds - 30} PRECEDING AND CURRENT ROW)"""


@query("e05_rate_5m", _rate_sql(300))
def rate_5m(t: Tables) -> DataFrame:
    return metrics.moving_rate(t.events, ["event_type"], "ts", 300).withColumn("rate", F.round("rate", 9))


@query("e05_rate_30m", _rate_sql(1800))
def rate_30m(t: Tables) -> DataFrame:
    return metrics.moving_rate(t.events, ["event_type"], "ts", 1800).withColumn("rate", F.round("rate", 9))


@query(
    "e06_moving_average",
    """SELECT event_id, event_type, round(avg(value) OVER w, 6) AS mean, count(*) OVER w AS window_rows FROM events
    WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
)
def moving_average(t: Tables) -> DataFrame:
    rows = ordered.moving_mean(
        t.events, ["event_type"], ["event_id"], ordered.log_chunk(F.col("event_id"), SEGMENT), {"value": F.col("value")}
    )
    return rows.select(
        "event_id", "event_type", F.round(F.col("value_sum") / F.col("window_rows"), 6).alias("mean"), "window_rows"
    )


@query(
    "e07_streaks",
    """WITH r AS (SELECT user_id, event_id, value < 20 AS ok, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, event_id, rn - coalesce(max(CASE WHEN NOT ok THEN rn END) OVER w, 0) AS consecutive_successes,
      rn - coalesce(max(CASE WHEN ok THEN rn END) OVER w, 0) AS consecutive_failures FROM r
    WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
)
def streaks(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", "value")
    chunk = ordered.log_chunk(F.col("event_id"), SEGMENT)
    return ordered.streaks(rows, ["user_id"], ["event_id"], chunk, F.col("value") < 20).drop("value")


@query(
    "e08_condition_held",
    """WITH h AS (SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS "at", sum(CAST(value AS DECIMAL(18, 2))) AS total FROM events GROUP BY ALL),
    c AS (SELECT *, total > 40 AS hot, lag(total > 40) OVER w AS before FROM h WINDOW w AS (PARTITION BY event_type ORDER BY "at")),
    i AS (SELECT *, sum(CASE WHEN hot AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY "at") AS island FROM c)
    SELECT event_type, min("at") AS since, max("at") AS until, count(*) AS samples FROM i WHERE hot GROUP BY event_type, island
    HAVING max("at") - min("at") >= 7200""",
)
def condition_held(t: Tables) -> DataFrame:
    """Hours in which the amounts of a type stay above a limit for two hours or more."""
    hour = F.floor(F.unix_timestamp("ts") / 3600).cast("bigint") * 3600
    points = t.events.groupBy("event_type", hour.alias("at")).agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    return alerts.episodes(points, ["event_type"], "at", F.col("total") > 40, 7200)


def metric_samples(t: Tables) -> DataFrame:
    """Samples for all alert rules, derived from the events of each type and stored by metric."""
    k, value, one = F.col("k"), F.col("value"), F.lit(1.0)
    samples = {
        "cdc_lag_seconds": value * 3,
        "checkpoint_lag_seconds": value * 4,
        "sync_lag_by_table_seconds": value * 5,
        "memory_usage_bytes": k / 100 * alerts.GIB * 8,
        "connection_pool_saturation_ratio": k / 100,
        "processing_latency_seconds": value / 50,
        "circuit_breaker_state": F.when(k < 30, 1.0).otherwise(0.0),
        "active_sync_tasks": F.when(value < 10, 0.0).otherwise(1.0),
        "replication_lsn": F.when(k < 10, 0.0).otherwise(F.col("event_id").cast("double")),
        "at_least_once_violations_total": F.when(k < 5, one),
        "dead_letter_events_total": F.when(F.col("event_type") == "error", one),
        "cdc_events_total": one,
        "cdc_events_failed_total": F.when(k < 8, one),
        "documents_synced_total": one,
    }
    items = F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in samples.items()])
    outcome = F.when(F.col("event_type") == "error", "failed").otherwise("success")
    # The number is read once per event, and dealt out before the samples are made and sorted by metric.
    events = t.events.select("event_id", "event_type", "ts", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    rows = events.repartition("event_id").select(
        F.explode(items).alias("s"), F.col("event_type").alias("series"), outcome.alias("outcome"), "ts"
    )
    rows = rows.where("s.value IS NOT NULL").select("s.metric", "series", "outcome", "ts", "s.value")
    path = scratch_path(t.spark, "samples")
    rows.write.partitionBy("metric").parquet(path)
    return t.spark.read.schema(alerts.SAMPLE_SCHEMA).parquet(path)


@query(
    "e08_gauge_alerts",
    """WITH s AS (SELECT event_type AS series, (CAST(floor(epoch(ts) / 30) AS BIGINT) + 1) * 30 AS "at", arg_max(value * 3, (ts, value * 3)) AS v FROM events GROUP BY ALL),
    n AS (SELECT *, lead("at") OVER (PARTITION BY series ORDER BY "at") AS nxt FROM s),
    c AS (SELECT *, v > 60 AS hot, lag(v > 60) OVER (PARTITION BY series ORDER BY "at") AS before FROM n),
    i AS (SELECT *, sum(CASE WHEN hot AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY "at") AS island FROM c),
    e AS (SELECT series, min("at") AS since, max(coalesce(nxt - 30, "at")) AS until FROM i WHERE hot GROUP BY series, island)
    SELECT 'HighCDCLag' AS alert, 'warning' AS severity, series, since, until, since + 300 AS fires_at FROM e WHERE until - since >= 300""",
)
def gauge_alerts(t: Tables) -> DataFrame:
    """One shipped rule: a level above 60 that holds for five minutes, on a 30 second grid."""
    wanted = [r for r in alerts.RULES if r.name == "HighCDCLag"]
    return alerts.evaluate(metric_samples(t).where("metric = 'cdc_lag_seconds'"), wanted)


@query(
    "e08_stale_gauges",
    """WITH s AS (SELECT event_type AS series, (CAST(floor(epoch(ts) / 30) AS BIGINT) + 1) * 30 AS "at", arg_max(value * 3, (ts, value * 3)) AS v FROM events GROUP BY ALL),
    n AS (SELECT *, least(coalesce(lead("at") OVER w, "at" + 300), "at" + 300) AS ends, lag("at") OVER w AS prior FROM s WINDOW w AS (PARTITION BY series ORDER BY "at")),
    c AS (SELECT *, v > 60 AS hot, lag(v > 60) OVER w AND prior + 300 >= "at" AS before FROM n WINDOW w AS (PARTITION BY series ORDER BY "at")),
    i AS (SELECT *, sum(CASE WHEN hot AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY "at") AS island FROM c),
    e AS (SELECT series, min("at") AS since, max(ends - 30) AS until FROM i WHERE hot GROUP BY series, island)
    SELECT 'HighCDCLag' AS alert, 'warning' AS severity, series, since, until, since + 300 AS fires_at FROM e WHERE until - since >= 300""",
)
def stale_gauges(t: Tables) -> DataFrame:
    """The same rule with levels that count for five minutes at most."""
    wanted = [r for r in alerts.RULES if r.name == "HighCDCLag"]
    return alerts.evaluate(metric_samples(t).where("metric = 'cdc_lag_seconds'"), wanted, lookback=300)


# The values of metric_samples over events (v: the event's value, k: the number in its properties).
SAMPLE_SQL = {
    "cdc_lag_seconds": "v * 3",
    "checkpoint_lag_seconds": "v * 4",
    "sync_lag_by_table_seconds": "v * 5",
    "memory_usage_bytes": f"k / 100 * {alerts.GIB!r}::DOUBLE * 8",
    "connection_pool_saturation_ratio": "k / 100",
    "processing_latency_seconds": "v / 50",
    "circuit_breaker_state": "CASE WHEN k < 30 THEN 1.0 ELSE 0.0 END::DOUBLE",
    "active_sync_tasks": "CASE WHEN v < 10 THEN 0.0 ELSE 1.0 END::DOUBLE",
    "replication_lsn": "CASE WHEN k < 10 THEN 0.0 ELSE event_id END::DOUBLE",
    "at_least_once_violations_total": "CASE WHEN k < 5 THEN 1.0 END::DOUBLE",
    "dead_letter_events_total": "CASE WHEN event_type = 'error' THEN 1.0 END::DOUBLE",
    "cdc_events_total": "1.0::DOUBLE",
    "cdc_events_failed_total": "CASE WHEN k < 8 THEN 1.0 END::DOUBLE",
    "documents_synced_total": "1.0::DOUBLE",
}


@query("e08_all_alert_rules", rules_sql(SAMPLE_SQL, alerts.RULES))
def all_alert_rules(t: Tables) -> DataFrame:
    return alerts.evaluate(metric_samples(t))


@query(
    "e09_order_check",
    """WITH r AS (SELECT event_type, event_id, event_id + CASE WHEN event_id % 50 = 0 THEN 400 ELSE 0 END AS lsn_num FROM events),
    p AS (SELECT *, lag(lsn_num) OVER (PARTITION BY event_type ORDER BY event_id) AS previous FROM r)
    SELECT event_type, event_id, lsn_num, previous FROM p WHERE lsn_num <= previous""",
)
def order_check(t: Tables) -> DataFrame:
    """Arrivals whose position does not grow; every fiftieth change carries a position from the future."""
    late = F.when(F.col("event_id") % 50 == 0, 400).otherwise(0)
    rows = t.events.select("event_type", "event_id", (F.col("event_id") + late).alias("lsn_num"))
    chunk = ordered.log_chunk(F.col("event_id"), SEGMENT)
    return ordered.order_violations(rows, ["event_type"], ["event_id"], chunk, "lsn_num")


@query(
    "e09_turn_order",
    """WITH c AS (SELECT conv_id, turn FROM conversations WHERE (conv_id * 7 + turn) % 5 <> 0)
    SELECT conv_id, turn, previous FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM c)
    WHERE turn <= previous OR turn - previous > 1""",
)
def turn_order(t: Tables) -> DataFrame:
    """Gaps in the turns of conversations that lost every fifth message."""
    rows = t.conversations.where("(conv_id * 7 + turn) % 5 <> 0").select("conv_id", "turn")
    found = ordered.running(
        rows, ["conv_id"], ["turn"], ordered.log_chunk(F.col("turn"), 2), {"previous": ("prev", F.col("turn"))}
    )
    return found.where("turn <= previous OR turn - previous > 1")


@query(
    "e_rows_numbered",
    "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events",
)
def rows_numbered(t: Tables) -> DataFrame:
    rows = t.events.select("event_type", "event_id")
    return ordered.numbered(rows, ["event_type"], ["event_id"], ordered.log_chunk(F.col("event_id"), SEGMENT))


@query(
    "e_newest_overall",
    "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 750",
)
def newest_overall(t: Tables) -> DataFrame:
    return topk.keep_newest(t.events.select("event_id", "ts"), 750, "ts", "event_id", "hour")


def _tied_sql(order: str, n: int) -> str:
    return f"WITH {TIED} SELECT * FROM tied QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY {order}) <= {n}"


# Ties are cut the same way whether or not tasks cut their share first.
for _n in (5, 2000):

    @query(f"e03_newest_of_ties_{_n}", _tied_sql("created_at DESC, id DESC", _n))
    def newest_of_ties(t: Tables, n: int = _n) -> DataFrame:
        return topk.newest_per_key(tied_rows(t), ["task_id"], n, "created_at", "id")

    @query(f"e04_oldest_of_ties_{_n}", _tied_sql("created_at, id", _n))
    def oldest_of_ties(t: Tables, n: int = _n) -> DataFrame:
        return topk.oldest_per_key(tied_rows(t), ["task_id"], n, "created_at", "id")
