"""Joins (section C) and set operations (section G)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.config import SyncTask
from driftline.operators import deadletters, jobs, metrics, progress, routing, topk
from driftline.operators.asof import asof_join
from driftline.sources import tables
from driftline.workload.base import LOG, Tables, query

TASKS = [
    SyncTask("t1", "en.src1", "first"),
    SyncTask("t2", "src1", "any_first"),
    SyncTask("t3", ' "EN"."Src2" ', "second"),
    SyncTask("t4", "src3", "third"),
    SyncTask("t5", "fr.src3", "third_fr"),
    SyncTask("t6", "", "nothing"),
]


@query(
    "c01_index_routing",
    """SELECT doc_id, CASE WHEN source = 'src1' THEN 'any_first' WHEN source = 'src2' THEN 'second'
      WHEN source = 'src3' AND lang = 'fr' THEN 'third_fr' WHEN source = 'src3' THEN 'third_fr' ELSE lang || '.' || upper(source) END AS idx
    FROM (SELECT doc_id, lang, source FROM documents)
    WHERE NOT (source = 'src1' AND lang = 'en')
    UNION ALL SELECT doc_id, 'first' FROM documents WHERE source = 'src1' AND lang = 'en'""",
)
def index_routing(t: Tables) -> DataFrame:
    """Later tasks win the bare key: ``src1`` is any_first and ``src3`` third_fr."""
    rows = t.documents.select(
        "doc_id",
        F.concat(F.lit(' "'), F.col("lang"), F.lit('"')).alias("schema_name"),
        F.upper("source").alias("table_name"),
        F.concat_ws(".", "lang", F.upper("source")).alias("full_name"),
    )
    return routing.route_to_index(rows, TASKS, fallback="full_name").select("doc_id", F.col("index").alias("idx"))


@query(
    "c02_task_fan_out",
    """SELECT doc_id, 't1' AS task_id FROM documents WHERE lang = 'en' AND source = 'src1'
    UNION ALL SELECT doc_id, 't2' FROM documents WHERE source = 'src1'
    UNION ALL SELECT doc_id, 't4' FROM documents WHERE source = 'src3'
    UNION ALL SELECT doc_id, 't5' FROM documents WHERE lang = 'fr' AND source = 'src3'""",
)
def task_fan_out(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.col("lang").alias("schema_name"), F.col("source").alias("table_name"))
    return routing.fan_out(rows, TASKS).select("doc_id", "task_id")


@query(
    "c03_untouched_rows",
    f"""WITH {LOG} SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT k FROM chg WHERE value > 150)""",
)
def untouched_rows(t: Tables) -> DataFrame:
    changed = t.log.where("value > 150").select(F.col("k").alias("task_id"))
    customers = t.customer.select(F.col("c_custkey").alias("task_id"), "c_name")
    return progress.orphans(customers, changed).withColumnRenamed("task_id", "c_custkey")


@query(
    "c04_asof_latest_label",
    """SELECT c.conv_id, c.turn, u.turn AS asked_at, md5(u.text) AS question
    FROM (SELECT * FROM conversations WHERE role <> 'user') c
    ASOF LEFT JOIN (SELECT * FROM conversations WHERE role = 'user') u ON c.conv_id = u.conv_id AND c.turn >= u.turn""",
)
def asof_latest_label(t: Tables) -> DataFrame:
    """Each answer with the newest question before it in its conversation."""
    answers = t.conversations.where("role <> 'user'").select("conv_id", "turn")
    questions = t.conversations.where("role = 'user'").select(
        "conv_id", "turn", F.col("turn").alias("asked_at"), F.md5("text").alias("question")
    )
    return asof_join(answers, questions, "conv_id", "turn", ["asked_at", "question"], segment=2)


@query(
    "c05_orphan_progress",
    "SELECT o_custkey AS task_id, o_orderkey AS position FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)",
)
def orphan_progress(t: Tables) -> DataFrame:
    saved = t.orders.select(F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("position"))
    return progress.orphans(saved, t.events.select(F.col("user_id").alias("task_id")))


@query(
    "c06_job_stats",
    """SELECT c.c_custkey AS job, c.c_name AS job_name, count(o.o_orderkey) AS total_runs,
      count(CASE WHEN o.o_orderstatus = 'O' THEN 1 END) AS successful_runs, count(CASE WHEN o.o_orderstatus = 'F' THEN 1 END) AS failed_runs,
      max(o.o_orderdate) AS last_run, round(avg(CAST(o.o_orderkey % 1000 AS DOUBLE)), 6) AS avg_duration_seconds
    FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY ALL""",
)
def job_stats(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "succeeded").when(F.col("o_orderstatus") == "F", "failed")
    took = F.make_dt_interval(secs=(F.col("o_orderkey") % 1000).cast("decimal(18,6)"))
    runs = t.orders.select(
        F.col("o_custkey").alias("job"),
        status.alias("status"),
        F.col("o_orderdate").alias("start_time"),
        (F.col("o_orderdate") + took).alias("end_time"),
    )
    known = t.customer.select(F.col("c_custkey").alias("job"), F.col("c_name").alias("job_name"))
    stats = jobs.job_stats(known, runs, "job", "status", "start_time", "end_time")
    return stats.withColumn("avg_duration_seconds", F.round("avg_duration_seconds", 6))


@query(
    "c07_sampled_update",
    """WITH picked AS (SELECT p_partkey FROM part WHERE p_size > 10 ORDER BY md5(p_partkey || ':7'), p_partkey LIMIT 20)
    SELECT p_partkey, CASE WHEN hit THEN round(p_retailprice * 0.5, 2) ELSE p_retailprice END AS p_retailprice,
      CASE WHEN hit THEN greatest(0, p_size - 20) ELSE p_size END AS p_size
    FROM (SELECT *, p_partkey IN (SELECT p_partkey FROM picked) AS hit FROM part)""",
)
def sampled_update(t: Tables) -> DataFrame:
    picked = topk.sample_rows(t.part.where("p_size > 10"), "p_partkey", 20, 7)
    changes = {
        "p_retailprice": F.round(F.col("p_retailprice") * 0.5, 2),
        "p_size": F.greatest(F.lit(0), F.col("p_size") - 20),
    }
    return jobs.update_picked(t.part, picked, "p_partkey", changes).select("p_partkey", "p_retailprice", "p_size")


@query(
    "c07_sampled_rows",
    """SELECT p_partkey, p_name FROM part WHERE p_partkey IN
      (SELECT p_partkey FROM part WHERE p_size > 10 ORDER BY md5(p_partkey || ':7'), p_partkey LIMIT 20)""",
)
def sampled_rows(t: Tables) -> DataFrame:
    picked = topk.sample_rows(t.part.where("p_size > 10"), "p_partkey", 20, 7)
    return jobs.picked_rows(t.part, picked, "p_partkey").select("p_partkey", "p_name")


@query(
    "c08_resume_points",
    """WITH p AS (SELECT user_id AS task_id, max(event_id) AS position FROM events GROUP BY user_id),
    j AS (SELECT 'src_' || c_nationkey AS source_name, c_custkey AS task_id, position FROM customer LEFT JOIN p ON c_custkey = task_id)
    SELECT source_name, count(*) AS tasks, count(position) AS tasks_with_progress, min(position) AS resume_from,
      arg_min(task_id, position) AS slowest_task FROM j GROUP BY source_name""",
)
def resume_points(t: Tables) -> DataFrame:
    tasks = t.customer.select(
        F.concat(F.lit("src_"), F.col("c_nationkey").cast("string")).alias("source_name"), F.col("c_custkey").alias("task_id")
    )
    saved = t.events.groupBy(F.col("user_id").alias("task_id")).agg(F.max("event_id").alias("position"))
    return progress.resume_points(tasks, saved)


# --- set operations -------------------------------------------------------------------------


@query(
    "g01_union_full_and_changes",
    f"""WITH {LOG} SELECT 'full' AS source_name, c_custkey AS k, c_acctbal AS value, NULL::VARCHAR AS op FROM customer
    UNION ALL SELECT 'changes', k, value, op FROM chg""",
)
def union_full_and_changes(t: Tables) -> DataFrame:
    full = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("value"))
    return tables.union_sources({"full": full, "changes": t.log.select("k", "value", "op")})


@query(
    "g02_count_report",
    """SELECT 'Total Orders' AS metric, count(*) AS value FROM orders
    UNION ALL SELECT 'Open', count(*) FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT 'Urgent Open', count(*) FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'""",
)
def count_report(t: Tables) -> DataFrame:
    is_open = F.col("o_orderstatus") == "O"
    return metrics.labelled_counts(
        t.orders,
        {"Total Orders": F.lit(True), "Open": is_open, "Urgent Open": is_open & (F.col("o_orderpriority") == "1-URGENT")},
    )


@query(
    "g03_key_difference",
    "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def key_difference(t: Tables) -> DataFrame:
    return deadletters.without(t.documents.select("doc_id"), t.labels, "doc_id")
