"""Sorts, cuts and samples (section F)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.positions import lsn_number, lsn_text
from driftline.operators import deadletters, ordered, topk
from driftline.workload.base import SEGMENT, Tables, query
from driftline.workload.scans import LETTERS, letters


@query(
    "f01_oldest_entries",
    f"WITH {LETTERS} SELECT id, created_at FROM letters WHERE task_id = 'task_3' ORDER BY created_at, id LIMIT 7",
)
def oldest_entries(t: Tables) -> DataFrame:
    return deadletters.by_task(letters(t), "task_3", 7).select("id", "created_at")


@query(
    "f02_newest_first",
    "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC",
)
def newest_first(t: Tables) -> DataFrame:
    return t.events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).select("event_id", "ts")


@query("f03_task_ids", f"WITH {LETTERS} SELECT DISTINCT task_id FROM letters ORDER BY task_id")
def task_ids(t: Tables) -> DataFrame:
    return deadletters.task_list(letters(t))


@query(
    "f04_position_order",
    """SELECT to_hex(event_id % 300) || '/' || to_hex(event_id * 977) AS lsn, (event_id % 300) * 4294967296 + event_id * 977 AS lsn_num
    FROM events ORDER BY lsn_num DESC""",
)
def position_order(t: Tables) -> DataFrame:
    """Numeric order of positions: 10/0 comes after F/0."""
    n = (F.col("event_id") % 300) * F.lit(4294967296) + F.col("event_id") * 977
    rows = t.events.select(lsn_text(n).alias("lsn"))
    rows = rows.withColumn("lsn_num", lsn_number(F.col("lsn")).cast("bigint"))
    return rows.orderBy(F.col("lsn_num").desc())


@query("f05_sample", "SELECT p_partkey, p_name FROM part ORDER BY md5(p_partkey || ':42'), p_partkey LIMIT 25")
def sample(t: Tables) -> DataFrame:
    return topk.sample_rows(t.part.select("p_partkey", "p_name"), "p_partkey", 25, 42)


@query(
    "f06_batch_cut",
    """SELECT event_type, event_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 50 AS batch_id FROM events""",
)
def batch_cut(t: Tables) -> DataFrame:
    rows = t.events.select("event_type", "event_id")
    return ordered.batch_numbers(rows, ["event_type"], ["event_id"], ordered.log_chunk(F.col("event_id"), SEGMENT), 50)


@query(
    "f06_batches",
    """WITH b AS (SELECT event_type, event_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 50 AS batch_id FROM events)
    SELECT event_type, batch_id, count(*) AS rows, min(event_id) AS first_lsn, max(event_id) AS last_lsn FROM b GROUP BY ALL""",
)
def batches(t: Tables) -> DataFrame:
    rows = ordered.batch_numbers(
        t.events.select("event_type", "event_id"), ["event_type"], ["event_id"], ordered.log_chunk(F.col("event_id"), SEGMENT), 50
    )
    return rows.groupBy("event_type", "batch_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min("event_id").alias("first_lsn"), F.max("event_id").alias("last_lsn")
    )
