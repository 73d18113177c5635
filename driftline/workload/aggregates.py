"""Aggregations (section D)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.jsondocs import json_array_has
from driftline.functions.values import to_number
from driftline.operators import deadletters, dedup, metrics, ordered, progress, softdelete
from driftline.operators import OP
from driftline.workload.base import DELIVERIES, LOG, SEGMENT, Tables, query
from driftline.workload.projections import GONE
from driftline.workload.scans import LETTERS, letters


@query(
    "d01_dead_letter_statistics",
    f"""WITH {LETTERS}, l AS (SELECT task_id, CASE WHEN error = '' THEN 'Unknown' ELSE split_part(error, chr(10), 1) END AS label, created_at FROM letters)
    SELECT 'total' AS scope, '' AS name, count(*) AS entries, min(created_at) AS oldest, max(created_at) AS newest FROM l
    UNION ALL SELECT 'task', task_id, count(*), min(created_at), max(created_at) FROM l GROUP BY task_id
    UNION ALL SELECT 'error', label, count(*), min(created_at), max(created_at) FROM l GROUP BY label""",
)
def dead_letter_statistics(t: Tables) -> DataFrame:
    return deadletters.statistics(letters(t))


@query(
    "d02_dead_letter_tasks",
    f"WITH {LETTERS} SELECT task_id, count(*) AS entries FROM letters GROUP BY task_id",
)
def dead_letter_tasks(t: Tables) -> DataFrame:
    return deadletters.counts_by_task(letters(t))


@query(
    "d03_dedup_statistics",
    f"""WITH {DELIVERIES} SELECT CAST(count(*) AS BIGINT) AS total_events, count(*) - count(DISTINCT (event_id, k)) AS duplicate_events,
      greatest(0, count(DISTINCT (event_id, k)) - 500) AS window_evictions,
      round((count(*) - count(DISTINCT (event_id, k))) / count(*), 9) AS duplicate_rate FROM dlv""",
)
def dedup_statistics(t: Tables) -> DataFrame:
    rows = t.deliveries.select(
        "lsn", F.lit(None).cast("bigint").alias("xid"), F.col("event_type").alias("table_name"), F.col("k").alias("pk")
    )
    stats = dedup.dedup_stats(rows, dedup.DELIVERY_KEY, window=500)
    return stats.withColumn("duplicate_rate", F.round("duplicate_rate", 9))


@query(
    "d04_progress_statistics",
    """SELECT user_id AS task_id, count(CASE WHEN event_type <> 'error' THEN 1 END) AS events_processed,
      count(CASE WHEN event_type = 'error' THEN 1 END) AS events_failed,
      CAST(coalesce(sum(CASE WHEN event_type <> 'error' THEN strlen(props) END), 0) AS BIGINT) AS bytes_processed,
      max(CASE WHEN event_type <> 'error' THEN ts END) AS last_event_at,
      round(count(CASE WHEN event_type <> 'error' THEN 1 END) / count(*), 9) AS success_rate FROM events GROUP BY user_id""",
)
def progress_statistics(t: Tables) -> DataFrame:
    rows = t.events.withColumnRenamed("user_id", "task_id")
    size = F.octet_length("props").cast("bigint")
    stats = progress.statistics(rows, ["task_id"], F.col("event_type") == "error", size, "ts")
    return stats.withColumn("success_rate", F.round("success_rate", 9))


@query(
    "d05_change_counts",
    f"""WITH {LOG} SELECT 'public.' || event_type AS "table", op, count(*) AS events FROM chg GROUP BY ALL""",
)
def change_counts(t: Tables) -> DataFrame:
    rows = t.log.select(F.lit("public").alias("schema_name"), F.col("event_type").alias("table_name"), "op")
    return metrics.change_counts(rows)


@query(
    "d06_apply_results",
    f"""WITH {LOG} SELECT op AS idx, count(CASE WHEN value <= 100 THEN 1 END) AS success_count, count(CASE WHEN value > 100 THEN 1 END) AS error_count,
      max(CASE WHEN value <= 100 THEN event_id END) AS last_position, min(CASE WHEN value > 100 THEN 'too large: ' || event_type END) AS sample_error
    FROM chg GROUP BY op""",
)
def apply_results(t: Tables) -> DataFrame:
    error = F.concat(F.lit("too large: "), F.col("event_type"))
    rows = t.log.withColumnRenamed("op", "idx")
    return metrics.apply_results(rows, "idx", F.col("value") > 100, "event_id", error)


@query(
    "d06_apply_errors",
    f"""WITH {LOG} SELECT op AS idx, 'too large: ' || event_type AS error, count(*) AS rows FROM chg WHERE value > 100 GROUP BY ALL""",
)
def apply_errors(t: Tables) -> DataFrame:
    error = F.concat(F.lit("too large: "), F.col("event_type"))
    return metrics.apply_errors(t.log.withColumnRenamed("op", "idx"), "idx", F.col("value") > 100, error)


@query(
    "d07_index_statistics",
    """WITH d AS (SELECT doc_id, text, CASE WHEN lang <> 'es' THEN lang END AS lang, CASE WHEN n_chars > 500 THEN source END AS source, n_chars FROM documents),
    n AS (SELECT count(*) AS n FROM d)
    SELECT n AS number_of_documents, 'doc_id' AS field, (SELECT count(doc_id) FROM d) AS documents FROM n
    UNION ALL SELECT n, 'text', (SELECT count(text) FROM d) FROM n UNION ALL SELECT n, 'lang', (SELECT count(lang) FROM d) FROM n
    UNION ALL SELECT n, 'source', (SELECT count(source) FROM d) FROM n UNION ALL SELECT n, 'n_chars', (SELECT count(n_chars) FROM d) FROM n""",
)
def index_statistics(t: Tables) -> DataFrame:
    docs = t.documents.withColumns(
        {
            "lang": F.when(F.col("lang") != "es", F.col("lang")),
            "source": F.when(F.col("n_chars") > 500, F.col("source")),
        }
    )
    return metrics.field_distribution(docs)


@query(
    "d08_batch_size_histogram",
    """WITH b AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS n FROM events)
    SELECT event_type, le, sum(CASE WHEN n <= bound THEN 1 ELSE 0 END)::BIGINT AS cumulative FROM b,
      (VALUES ('1.0', 1.0), ('5.0', 5.0), ('10.0', 10.0), ('50.0', 50.0), ('100.0', 100.0), ('500.0', 500.0), ('1000.0', 1000.0), ('+Inf', 1e18)) v(le, bound)
    GROUP BY event_type, le""",
)
def batch_size_histogram(t: Tables) -> DataFrame:
    rows = t.events.select("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("n"))
    hist = metrics.histogram(rows, ["event_type"], F.col("n"), metrics.BATCH_SIZE_BOUNDS)
    return metrics.histogram_rows(hist, ["event_type"], metrics.BATCH_SIZE_BOUNDS)


LATENCIES = {
    "event": metrics.EVENT_LATENCY_BOUNDS,
    "store": metrics.STORE_LATENCY_BOUNDS,
    "commit": metrics.COMMIT_LATENCY_BOUNDS,
}
LATENCY_CELLS = ", ".join(
    f"('{kind}', '{le}', {bound})"
    for kind, bounds in LATENCIES.items()
    for le, bound in [*((repr(b), f"{b!r}::DOUBLE") for b in bounds), ("+Inf", "'Infinity'::DOUBLE")]
)


@query(
    "d08_latency_histograms",
    f"""SELECT kind, event_type, le, count(CASE WHEN value / 50 <= bound THEN 1 END) AS cumulative
    FROM events, (VALUES {LATENCY_CELLS}) v(kind, le, bound) GROUP BY ALL""",
)
def latency_histograms(t: Tables) -> DataFrame:
    """One scan per kind of latency, each with its own bounds."""
    rows = t.events.select("event_type", (F.col("value") / 50).alias("seconds"))
    parts = [
        metrics.histogram_rows(metrics.histogram(rows, ["event_type"], F.col("seconds"), b), ["event_type"], b).withColumn("kind", F.lit(kind))
        for kind, b in LATENCIES.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _quantile_sql(q: float) -> str:
    """Interpolated quantile over rows ``b(table_name, stage, bound, low, cum, prev, n)``."""
    return f"""coalesce(min(CASE WHEN cum >= {q}::DOUBLE * n THEN
        struct_pack(bound := bound, v := CASE WHEN cum > prev THEN low + (bound - low) * (({q}::DOUBLE * n - prev) / (cum - prev)) ELSE bound END) END).v, 5.0)"""


BOUND_VALUES = ", ".join(
    f"({low}::DOUBLE, {high}::DOUBLE)"
    for low, high in zip((0.0, *metrics.STAGE_LATENCY_BOUNDS[:-1]), metrics.STAGE_LATENCY_BOUNDS)
)


@query(
    "d09_latency_quantiles",
    f"""WITH {LOG}, s AS (SELECT event_type AS table_name, op AS stage, value / 100 AS seconds FROM chg),
    b AS (SELECT table_name, stage, high AS bound, low, CAST(sum(CASE WHEN seconds <= high THEN 1 ELSE 0 END) AS BIGINT) AS cum,
        CAST(sum(CASE WHEN seconds <= low AND low > 0 THEN 1 ELSE 0 END) AS BIGINT) AS prev, count(*) AS n
      FROM s, (VALUES {BOUND_VALUES}) v(low, high) GROUP BY table_name, stage, low, high)
    SELECT table_name, stage, any_value(n) AS count, round({_quantile_sql(0.95)}, 9) AS p95, round({_quantile_sql(0.99)}, 9) AS p99
    FROM b GROUP BY table_name, stage""",
)
def latency_quantiles(t: Tables) -> DataFrame:
    rows = t.log.select(
        F.col("event_type").alias("table_name"), F.col("op").alias("stage"), (F.col("value") / 100).alias("seconds")
    )
    wanted = {"p95": 0.95, "p99": 0.99}
    found = metrics.quantiles(
        rows, ["table_name", "stage"], F.col("seconds"), metrics.STAGE_LATENCY_BOUNDS, wanted
    )
    return found.withColumns({n: F.round(n, 9) for n in wanted})


@query(
    "d10_failure_ratio",
    """WITH s AS (SELECT user_id AS task, (CAST(floor(epoch(ts) / 30) AS BIGINT) + 1) * 30 AS "at",
        sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS f, count(*) AS n FROM events GROUP BY ALL)
    SELECT task, "at", sum(f) OVER w ::BIGINT AS part, sum(n) OVER w ::BIGINT AS total, round(sum(f) OVER w / sum(n) OVER w, 9) AS ratio FROM s
    WINDOW w AS (PARTITION BY task ORDER BY "at" RANGE BETWEEN 86370 PRECEDING AND CURRENT ROW)""",
)
def failure_ratio(t: Tables) -> DataFrame:
    rows = t.events.withColumnRenamed("user_id", "task")
    found = metrics.moving_ratio(rows, ["task"], "ts", F.col("event_type") == "error", window=86400, step=30)
    return found.withColumn("ratio", F.round("ratio", 9))


@query(
    "d10_success_ratio_slo",
    """WITH s AS (SELECT (CAST(floor(epoch(ts) / 30) AS BIGINT) + 1) * 30 AS "at",
        sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)::BIGINT AS ok, count(*) AS n FROM events GROUP BY ALL)
    SELECT "at", sum(ok) OVER w ::BIGINT AS part, sum(n) OVER w ::BIGINT AS total, round(sum(ok) OVER w / sum(n) OVER w, 9) AS ratio FROM s
    WINDOW w AS (ORDER BY "at" RANGE BETWEEN 1770 PRECEDING AND CURRENT ROW)""",
)
def success_ratio(t: Tables) -> DataFrame:
    rows = t.events.withColumn("all", F.lit(1))
    found = metrics.moving_ratio(rows, ["all"], "ts", F.col("event_type") != "error", window=1800, step=30)
    return found.select("at", "part", "total", F.round("ratio", 9).alias("ratio"))


@query(
    "d11_lag",
    """WITH l AS (SELECT event_type, round(value) AS lag, ts + to_microseconds(CAST(round(value) AS BIGINT) * 1000000) AS done FROM events)
    SELECT event_type, max(lag) AS max_lag_seconds, arg_max(lag, (done, lag)) AS current_lag_seconds, count(*) AS events FROM l GROUP BY event_type
    UNION ALL SELECT NULL, max(lag), arg_max(lag, (done, lag)), count(*) FROM l""",
)
def lag(t: Tables) -> DataFrame:
    took = F.make_dt_interval(secs=F.round("value").cast("decimal(18,6)"))
    rows = t.events.select("event_type", "ts", (F.col("ts") + took).alias("done"))
    return metrics.lag_report(rows, ["event_type"], "ts", "done")


@query(
    "d12_batch_report",
    """WITH b AS (SELECT event_type AS table_name, event_id, CAST(floor(value * 10) AS BIGINT) AS ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS size,
        row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn, value FROM events)
    SELECT table_name, CAST(sum(ms) // count(*) AS BIGINT) AS average_latency_ms, round(avg(value), 6) AS average_throughput, count(*) AS metrics_count,
      arg_max(size, event_id) AS current_batch_size FROM b WHERE rn <= 10 GROUP BY table_name""",
)
def batch_report(t: Tables) -> DataFrame:
    rows = t.events.select(
        F.col("event_type").alias("table_name"),
        "event_id",
        F.floor(F.col("value") * 10).cast("bigint").alias("ms"),
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("size"),
    )
    found = metrics.batch_report(rows, "table_name", ["event_id"], "ms", "value", "size")
    return found.withColumn("average_throughput", F.round("average_throughput", 6))


STATES = "CASE event_type WHEN 'signup' THEN 'running' WHEN 'view' THEN 'paused' WHEN 'click' THEN 'idle' WHEN 'purchase' THEN 'completed' END"
STATUS_SQL = f"""st AS (SELECT user_id AS task_id, {STATES} AS state, CASE WHEN event_type = 'error' THEN props END AS error, event_id, ts FROM events),
    g AS (SELECT task_id, arg_max(state, event_id) AS s, count(error) AS error_count, arg_max(error, event_id) AS last_error, max(ts) AS last_updated
      FROM st GROUP BY task_id),
    status AS (SELECT task_id, error_count, last_error, last_updated, CASE WHEN error_count > 10 THEN 'failed' ELSE coalesce(s, 'idle') END AS state FROM g)"""


def status(t: Tables) -> DataFrame:
    log = t.events.select(
        F.col("user_id").alias("task_id"),
        F.expr(STATES).alias("state"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
        "event_id",
        "ts",
    )
    return progress.task_status(log, ["event_id"], "ts")


@query("d13_task_status", f"WITH {STATUS_SQL} SELECT * FROM status")
def task_status(t: Tables) -> DataFrame:
    return status(t)


@query(
    "d13_status_summary",
    f"""WITH {STATUS_SQL} SELECT count(*) AS total, count(CASE WHEN state = 'running' THEN 1 END) AS running,
      count(CASE WHEN state = 'failed' THEN 1 END) AS failed FROM status""",
)
def status_summary(t: Tables) -> DataFrame:
    return progress.status_summary(status(t))


@query(
    "d13_stale_failures",
    f"""WITH {STATUS_SQL} SELECT task_id, datesub('minute', last_updated, TIMESTAMP '2024-01-31') AS minutes_failed FROM status
    WHERE state = 'failed' AND TIMESTAMP '2024-01-31' - last_updated > INTERVAL 5 MINUTE""",
)
def stale_failures(t: Tables) -> DataFrame:
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return progress.stale_failures(status(t), now).select("task_id", "minutes_failed")


@query(
    "d14_catalogue_counts",
    """SELECT 'Total Products' AS metric, count(*) AS value FROM part
    UNION ALL SELECT 'Active Products', count(*) FROM part WHERE p_size < 45
    UNION ALL SELECT 'Out of Stock', count(*) FROM part WHERE p_size % 7 = 0 AND p_size < 45
    UNION ALL SELECT 'On Sale', count(*) FROM part WHERE p_name LIKE 'red %' AND p_size < 45
    UNION ALL SELECT 'Products Added Today', count(*) FROM part WHERE p_partkey % 30 = 0""",
)
def catalogue_counts(t: Tables) -> DataFrame:
    """Five labelled counts in one scan; a deletion time, tags and a creation date are derived."""
    today = F.lit("2024-02-01").cast("date")
    rows = t.part.select(
        F.when(F.col("p_size") >= 45, today).alias("deleted_at"),
        (F.col("p_size") % 7 != 0).alias("in_stock"),
        F.when(F.col("p_name").startswith("red "), '["new","sale"]').otherwise('["new"]').alias("tags"),
        F.date_sub(today, (F.col("p_partkey") % 30).cast("int")).alias("created"),
    )
    live = F.col("deleted_at").isNull()
    return metrics.labelled_counts(
        rows,
        {
            "Total Products": F.lit(True),
            "Active Products": live,
            "Out of Stock": ~F.col("in_stock") & live,
            "On Sale": json_array_has(F.col("tags"), "sale") & live,
            "Products Added Today": F.col("created") == today,
        },
    )


@query(
    "d15_soft_delete_counts",
    f"""WITH {LOG} SELECT 'Items' AS table_name, 'event_type' AS field, event_type AS value, count(*) AS events FROM chg
    WHERE op = 'update' AND event_type = 'click' GROUP BY ALL""",
)
def soft_delete_counts(t: Tables) -> DataFrame:
    rows = t.change_rows.withColumn("was", F.col(OP))
    changed = softdelete.soft_delete_changes(rows, GONE).where((F.col("was") == "update") & (F.col(OP) == "delete"))
    return changed.groupBy(
        F.col("__table").alias("table_name"), F.lit(GONE.field).alias("field"), F.col(GONE.field).alias("value")
    ).agg(F.count(F.lit(1)).alias("events"))


@query(
    "d16_earliest_position",
    """SELECT 'db_' || (user_id % 4) AS source_name, min(event_id) AS resume_from FROM
      (SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id) GROUP BY ALL""",
)
def earliest_position(t: Tables) -> DataFrame:
    saved = t.events.groupBy(F.col("user_id").alias("task_id")).agg(F.max("event_id").alias("position"))
    tasks = saved.select("task_id", F.concat(F.lit("db_"), (F.col("task_id") % 4).cast("string")).alias("source_name"))
    return progress.resume_points(tasks, saved).select("source_name", "resume_from")


ERROR_TEXTS = {
    "view": "Connection refused",
    "error": "'x' is no number",
    "click": "Index items not found",
    "purchase": "Too many requests",
}


def attempts(t: Tables) -> DataFrame:
    """Attempts per task: signups succeed, the others fail with a text by type."""
    texts = F.create_map(*[F.lit(x) for pair in ERROR_TEXTS.items() for x in pair])
    rows = t.events.select(
        F.col("user_id").alias("task_id"),
        "event_id",
        F.try_element_at(texts, F.col("event_type")).alias("error"),
        (F.get_json_object("props", "$.k").cast("int") % 5).alias("retry_count"),
        (F.col("ts") - F.make_dt_interval(mins=F.get_json_object("props", "$.k").cast("int"))).alias("first_error"),
        F.col("ts").alias("last_error"),
    )
    runs = ordered.streaks(rows, ["task_id"], ["event_id"], ordered.log_chunk(F.col("event_id"), SEGMENT), F.col("error").isNull())
    return deadletters.with_error_class(runs)


ATTEMPTS = """a AS (SELECT user_id AS task_id, event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS n,
      event_id - coalesce(max(CASE WHEN event_type = 'signup' THEN event_id END) OVER w, -1) AS since,
      row_number() OVER w AS rn, event_type <> 'signup' AS bad FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    s AS (SELECT *, rn - coalesce(max(CASE WHEN NOT bad THEN rn END) OVER (PARTITION BY task_id ORDER BY event_id), 0) AS streak FROM a)"""


@query(
    "d17_error_triage",
    f"""WITH {ATTEMPTS} SELECT task_id, event_id, CASE event_type WHEN 'view' THEN 'network' WHEN 'error' THEN 'data_validation'
        WHEN 'click' THEN 'not_found' ELSE 'rate_limit' END AS error_class, streak AS consecutive_failures,
      CASE WHEN streak >= 10 THEN 'pause' WHEN event_type = 'error' THEN 'dead_letter'
        WHEN event_type = 'click' THEN CASE WHEN n % 5 < 2 THEN 'retry' ELSE 'skip' END
        WHEN event_type = 'purchase' THEN 'retry'
        WHEN n % 5 < 3 THEN 'retry' WHEN n > 30 THEN 'pause' ELSE 'dead_letter' END AS action
    FROM s WHERE bad""",
)
def error_triage(t: Tables) -> DataFrame:
    rows = attempts(t).where("error IS NOT NULL")
    action = deadletters.triage_action(
        F.col("error_class"),
        F.col("retry_count"),
        F.col("consecutive_failures"),
        F.col("first_error"),
        F.col("last_error"),
    )
    return rows.select("task_id", "event_id", "error_class", "consecutive_failures", action.alias("action"))


@query(
    "d17_errors_by_class",
    """SELECT user_id AS task_id, CASE event_type WHEN 'view' THEN 'network' WHEN 'error' THEN 'data_validation'
        WHEN 'click' THEN 'not_found' ELSE 'rate_limit' END AS error_class, count(*) AS errors FROM events WHERE event_type <> 'signup' GROUP BY ALL""",
)
def errors_by_class(t: Tables) -> DataFrame:
    texts = F.create_map(*[F.lit(x) for pair in ERROR_TEXTS.items() for x in pair])
    rows = t.events.select(
        F.col("user_id").alias("task_id"), F.try_element_at(texts, F.col("event_type")).alias("error")
    ).where("error IS NOT NULL")
    return deadletters.totals_by_class(deadletters.with_error_class(rows))


@query(
    "d_conversion_failures",
    """SELECT event_type, count(*) AS rows, count(CASE WHEN event_type <> 'click' THEN 1 END) AS failed FROM events GROUP BY event_type""",
)
def conversion_failures(t: Tables) -> DataFrame:
    """How many rows of each kind fail a number conversion."""
    text = F.when(F.col("event_type") == "click", F.col("value").cast("string")).otherwise(F.col("props"))
    rows = t.events.select("event_type", text.alias("code"))
    _, error = to_number(F.col("code"), rows.schema["code"].dataType)
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.count(error).alias("failed"))
