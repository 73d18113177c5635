"""Streaming jobs (section I), drained over the event log and read back."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.config import Condition, Convert, EventFilter, SoftDelete, SyncTask, Transforms
from driftline.functions import pgtypes
from driftline.operators import LSN, OP, dedup, merge
from driftline.session import scratch_path
from driftline.sources import changelog, evolution
from driftline.sources.bucketed_table import BucketedTable
from driftline.sources.deadletter_table import DeadLetterTable
from driftline.sources.keyed_table import KeyedTable
from driftline.streaming import jobs, windows
from driftline.workload.base import LOG, SEGMENT, SNAPSHOT, Tables, op_of_event, query
from driftline.workload.scans import document_lines


def event_stream(t: Tables) -> DataFrame:
    return jobs.read_log(t.spark, t.path, t.events.schema, glob="events.parquet", max_files=1)


def drained(df: DataFrame, name: str) -> DataFrame:
    """Run a stream to its end into files and read them."""
    home = scratch_path(df.sparkSession, name)
    jobs.write_stream(df, f"{home}/out", f"{home}/checkpoint").awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{home}/out")


@query("i01_micro_batches", "SELECT event_id, event_type, value FROM events WHERE value > 10")
def micro_batches(t: Tables) -> DataFrame:
    return drained(event_stream(t).where("value > 10").select("event_id", "event_type", "value"), "batches")


@query("i02_stateful_dedup", "SELECT event_id, user_id, value FROM events")
def stateful_dedup(t: Tables) -> DataFrame:
    """Every change delivered once or twice, in one stream; each key comes out once."""
    twice = F.when(F.col("event_id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    stream = event_stream(t).withColumn("at", F.col("ts").cast("timestamp")).withColumn("copy", F.explode(twice))
    rows = dedup.stream_first_seen(stream, ["event_id", "user_id"], "at", "1 hour")
    return drained(rows.select("event_id", "user_id", "value"), "dedup")


LOG_TASK = SyncTask("items", "public.items", "items", ("k",), transform=Transforms(fields=(Convert("code", "number"),)))


def change_stream(t: Tables) -> DataFrame:
    return event_stream(t).select(
        op_of_event().alias(OP),
        F.col("event_id").alias(LSN),
        F.col("ts").alias("__ts"),
        F.col("user_id").alias("k"),
        "value",
        "props",
    )


MERGED = f"""WITH {LOG}, {SNAPSHOT},
    last AS (SELECT * FROM chg QUALIFY row_number() OVER (PARTITION BY k ORDER BY event_id DESC) = 1)
    SELECT k, value, props FROM snap WHERE k NOT IN (SELECT k FROM last)
    UNION ALL SELECT k, value, props FROM last WHERE op <> 'delete'"""


@query("i03_idempotent_apply", MERGED)
def idempotent_apply(t: Tables) -> DataFrame:
    """Stream the log onto the snapshot, then drain it again: nothing is applied twice."""
    home = scratch_path(t.spark, "apply")
    task = SyncTask("items", "public.items", "items", ("k",))
    target = KeyedTable(t.spark, f"{home}/items", ["k"], t.snapshot.schema)
    jobs.full_copy(t.snapshot, task, target)
    for _ in range(2):
        jobs.apply_changes(change_stream(t), task, target, f"{home}/checkpoint").awaitTermination()
    return target.current()


def bucketed(t: Tables, name: str, parts: int = 8, buckets: int = 4) -> BucketedTable:
    """The snapshot as a bucketed table of the catalogue, its files below the scratch folder."""
    path = scratch_path(t.spark, name)
    table = BucketedTable(t.spark, f"items_{path.rpartition('-')[2]}", ["k"], t.snapshot.schema, f"{path}/items", parts, buckets)
    table.write_base(t.snapshot)
    return table


@query("a17_bucketed_merge", MERGED)
def bucketed_merge(t: Tables) -> DataFrame:
    """The log in ten batches, each merged into the buckets its keys hash to, the last one twice."""
    table = bucketed(t, "bucketed")
    changes = change_events(t).drop("__ts", "__table", "__schema")
    last = (t.events.agg(F.max("event_id")).first()[0] or 0) + 1
    cuts = [last * i // 10 for i in range(11)]
    for a, b in [*zip(cuts[:-1], cuts[1:], strict=True), (cuts[-2], cuts[-1])]:
        table.merge(changes.where(F.col(LSN).between(a, b - 1)))
    return table.current()


@query("i03_bucketed_target", MERGED)
def bucketed_target(t: Tables) -> DataFrame:
    """A stream in four parts that merges into a bucketed table, then reads its whole log again from a new checkpoint."""
    table = bucketed(t, "bucketed-stream")
    task = SyncTask("items", "public.items", "items", ("k",))

    def changes(stream: DataFrame) -> DataFrame:
        return stream.select(op_of_event().alias(OP), F.col("event_id").alias(LSN), F.col("ts").alias("__ts"), F.col("user_id").alias("k"), "value", "props")

    def run(stream: DataFrame, home: str) -> None:
        jobs.apply_changes(changes(stream), task, table, f"{home}/checkpoint").awaitTermination()

    home = in_turn(t, "bucketed-log", quarters(t), run)
    again = changes(jobs.read_log(t.spark, f"{home}/landing", t.events.schema))
    jobs.apply_changes(again, task, table, f"{home}/second").awaitTermination()
    return table.current()


@query(
    "i03_lines_to_table",
    """SELECT doc_id, md5(text) AS text_md5, CASE WHEN lang <> 'es' THEN source END AS source, n_chars FROM documents WHERE lang <> 'de'""",
)
def lines_to_table(t: Tables) -> DataFrame:
    """From text lines of the log to a table: decode, run the task, merge."""
    home = scratch_path(t.spark, "lines")
    lsn = F.concat(F.lit("0/"), F.hex(F.monotonically_increasing_id()))
    document_lines(t).select(lsn.alias("lsn"), "data").write.parquet(f"{home}/landing")
    landed = jobs.read_log(t.spark, f"{home}/landing", t.spark.read.parquet(f"{home}/landing").schema, spread=True)
    types = {"doc_id": "int8", "text": "text", "source": "text", "n_chars": "int8"}
    target = KeyedTable(
        t.spark, f"{home}/items", ["doc_id"], "doc_id bigint, text string, source string, n_chars bigint", unchanged=True
    )
    # One table per language, registered in both ways.
    names = ["app.en_documents", "fr_documents", "app.de_documents", "es_documents"]
    routes = [jobs.Route(SyncTask(n, n, "documents", ("doc_id",)), target) for n in names]
    jobs.apply_log(changelog.change_rows(landed, types), routes, f"{home}/checkpoint").awaitTermination()
    return target.current().select("doc_id", F.md5("text").alias("text_md5"), "source", "n_chars")


def landed(t: Tables, name: str, rows: DataFrame, spread: bool = False) -> tuple[str, DataFrame]:
    """A frame as landed files, and the stream over them."""
    home = scratch_path(t.spark, name)
    rows.write.mode("append").parquet(f"{home}/landing")
    return home, jobs.read_log(t.spark, f"{home}/landing", rows.schema, spread=spread)


def in_turn(t: Tables, name: str, parts: list[DataFrame], run: Callable[[DataFrame, str], None]) -> str:
    """Lands one part after another and lets ``run`` drain the stream after each, as a new query on the same checkpoint.

    A part is written and read with its own partitions; a batch takes all of it.
    """
    home = scratch_path(t.spark, name)
    for part in parts:
        part.write.mode("append").parquet(f"{home}/landing")
        run(jobs.read_log(t.spark, f"{home}/landing", part.schema), home)
    return home


def quarters(t: Tables, again: int = 0) -> list[DataFrame]:
    """``events`` in four parts by position; each but the first brings the last ``again`` positions before it once more."""
    last = t.events.agg(F.max("event_id")).first()[0] or 0
    cuts = [last * k // 4 for k in range(4)]
    bounds = zip(cuts, [*cuts[1:], last + 1], strict=True)
    return [t.events.where(f"event_id >= {a - again if a else a} AND event_id < {b}") for a, b in bounds]


def change_events(t: Tables) -> DataFrame:
    return t.events.select(
        op_of_event().alias(OP),
        F.col("event_id").alias(LSN),
        F.col("ts").alias("__ts"),
        F.col("event_type").alias("__table"),
        F.lit("public").alias("__schema"),
        F.col("user_id").alias("k"),
        "value",
        "props",
    )


@query("i03_new_checkpoint", MERGED)
def new_checkpoint(t: Tables) -> DataFrame:
    """Half the log, a compaction, then a stream that lost its checkpoint and reads all of it."""
    rows = change_events(t).drop("__table", "__schema")
    home, stream = landed(t, "again", rows.where("__lsn < 300"))
    task = SyncTask("items", "public.items", "items", ("k",))
    target = KeyedTable(t.spark, f"{home}/items", ["k"], t.snapshot.schema)
    jobs.full_copy(t.snapshot, task, target)
    jobs.apply_changes(stream, task, target, f"{home}/first").awaitTermination()
    target.compact()
    rows.where("__lsn >= 300").write.mode("append").parquet(f"{home}/landing")
    jobs.apply_changes(stream, task, target, f"{home}/second").awaitTermination()
    return target.current()


@query(
    "i03_keyless_rows",
    f"""WITH {LOG}, keyed AS (SELECT * FROM chg WHERE event_id % 10 <> 0),
    last AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY k ORDER BY event_id DESC) = 1)
    SELECT 'item' AS kind, k, event_id AS position FROM last WHERE op <> 'delete'
    UNION ALL SELECT 'dead: No value for key field k', NULL, event_id FROM chg WHERE event_id % 10 = 0""",
)
def keyless_rows(t: Tables) -> DataFrame:
    """Changes without a key become dead letters; no row without a key is stored."""
    keyed = F.when(F.col(LSN) % 10 != 0, F.col("k"))
    rows = change_events(t).withColumns({"k": keyed, "position": F.col(LSN)}).drop("__table", "__schema")
    home, stream = landed(t, "keyless", rows)
    target = KeyedTable(t.spark, f"{home}/items", ["k"], "k bigint, position bigint")
    letters = DeadLetterTable(t.spark, f"{home}/dead")
    jobs.apply_changes(stream, SyncTask("items", "items", "items", ("k",)), target, f"{home}/checkpoint", letters).awaitTermination()
    target.compact()
    dead = letters.read().select(
        F.concat(F.lit("dead: "), "error").alias("kind"),
        F.lit(None).cast("bigint").alias("k"),
        F.get_json_object("event", "$.position").cast("bigint").alias("position"),
    )
    return target.current().select(F.lit("item").alias("kind"), "k", "position").unionByName(dead)


@query(
    "i03_many_tasks",
    f"""WITH {LOG}, last AS (SELECT * FROM chg WHERE event_type IN ('click', 'view')
        QUALIFY row_number() OVER (PARTITION BY event_type, k ORDER BY event_id DESC) = 1)
    SELECT event_type AS task_id, k, value FROM last WHERE op <> 'delete'""",
)
def many_tasks(t: Tables) -> DataFrame:
    """One log for two tasks, one registered with its schema; tables without a task are dropped."""
    tasks = [SyncTask(name, table, name, ("k",)) for name, table in (("click", "public.click"), ("view", "view"))]

    def target(task: SyncTask, home: str) -> KeyedTable:
        return KeyedTable(t.spark, f"{home}/{task.id}", ["k"], "k bigint, value double")

    def run(stream: DataFrame, home: str) -> None:
        jobs.apply_log(stream, [jobs.Route(task, target(task, home)) for task in tasks], f"{home}/checkpoint").awaitTermination()

    home = in_turn(t, "tasks", [change_events(t).where("__lsn < 300"), change_events(t).where("__lsn >= 300")], run)
    first, second = (target(task, home).current().select(F.lit(task.id).alias("task_id"), "k", "value") for task in tasks)
    return first.unionByName(second)


@query(
    "i02_late_first_deliveries",
    f"""WITH {LOG}, last AS (SELECT * FROM chg QUALIFY row_number() OVER (PARTITION BY k ORDER BY event_id DESC) = 1)
    SELECT k, value, (SELECT count(*) FROM chg) AS delivered FROM last WHERE op <> 'delete'""",
)
def late_first_deliveries(t: Tables) -> DataFrame:
    """The month lands backwards in three files and a part of it twice: every change counts once, however late."""
    rows = change_events(t).drop("__table", "__schema")
    parts = [rows.where("__ts >= '2024-01-20'"), rows.where("__ts >= '2024-01-10' AND __ts < '2024-01-25'"), rows.where("__ts < '2024-01-10'")]
    task = SyncTask("items", "items", "items", ("k",), options={"deduplicate": True, "deduplicate_within": "1 hour"})

    def tables(home: str) -> tuple[KeyedTable, KeyedTable]:
        items = KeyedTable(t.spark, f"{home}/items", ["k"], "k bigint, value double")
        return items, KeyedTable(t.spark, f"{home}/progress", ["task_id"], jobs.PROGRESS_SCHEMA)

    def run(stream: DataFrame, home: str) -> None:
        target, progress = tables(home)
        jobs.apply_changes(stream, task, target, f"{home}/checkpoint", progress=progress).awaitTermination()

    target, progress = tables(in_turn(t, "late-first", parts, run))
    total = progress.current().select(F.lit(1).alias("one"), F.col("total_processed").alias("delivered"))
    return target.current().withColumn("one", F.lit(1)).join(total, "one").drop("one")


@query(
    "i03_bad_lines",
    """WITH lines(id, detail) AS (VALUES (9, 'moved'), (3, 'c2'), (NULL, 'Cannot decode all fields of the change line'),
      (NULL, 'Cannot decode change line'), (NULL, 'Missing position'), (NULL, 'No value for key field id'))
    SELECT c_custkey * 10 + id AS id, detail FROM customer, lines""",
)
def bad_lines(t: Tables) -> DataFrame:
    """Per customer a key change, a soft delete, an update, and lines that cannot be decoded, located or keyed."""

    def row(op: str, digit: int, name: str, gone: bool = False, old: int | None = None) -> Column:
        key = lambda d: F.concat(F.lit("id[integer]:"), F.col("c_custkey") * 10 + d)
        before = [F.lit("old-key: "), key(old), F.lit(" new-tuple: ")] if old else []
        rest = F.lit(f" name[text]:'{name}' gone[boolean]:{str(gone).lower()}")
        return F.concat(F.lit(f"table public.u: {op}: "), *before, key(digit), rest)

    lines = [
        row("INSERT", 1, "a"),
        row("INSERT", 2, "b"),
        row("INSERT", 3, "c"),
        row("UPDATE", 9, "moved", old=1),
        row("UPDATE", 2, "b", gone=True, old=2),
        F.concat(row("INSERT", 4, "d"), F.lit(' "two words"[text]:\'x\'')),
        F.lit("table nonsense"),
        row("INSERT", 5, "far"),
        F.lit("table public.u: DELETE: (no-tuple-data)"),
        F.lit("table public.u: TRUNCATE: (no-flags)"),
        row("UPDATE", 3, "c2"),
    ]
    far = F.when(F.col("data").contains("'far'"), F.lit("FFFFFFFF/")).otherwise(F.lit("0/"))
    log = t.customer.select("c_custkey", F.posexplode(F.array(*lines)).alias("pos", "data"))
    log = log.select(F.concat(far, F.hex(F.col("c_custkey") * 16 + F.col("pos"))).alias("lsn"), "data")
    home, stream = landed(t, "bad-lines", log, spread=True)
    rows = changelog.change_rows(stream, {"id": "int8", "name": "text", "gone": "bool"}, keys=("id",))
    task = SyncTask("u", "public.u", "u", ("id",), soft_delete=SoftDelete("gone", (True,)))
    target = KeyedTable(t.spark, f"{home}/u", ["id"], "id bigint, name string, gone boolean")
    letters = DeadLetterTable(t.spark, f"{home}/dead")
    jobs.apply_changes(rows, task, target, f"{home}/checkpoint", letters).awaitTermination()
    dead = letters.read().select(F.lit(None).cast("bigint").alias("id"), F.col("error").alias("detail"))
    return target.current().select("id", F.col("name").alias("detail")).unionByName(dead)


def watched(df: DataFrame, home: str) -> windows.Totals:
    """Runs a stream to its end into files below ``home``."""
    return windows.run_watched(df.sparkSession, lambda: jobs.write_stream(df, f"{home}/out", f"{home}/checkpoint"))


def timed_events(t: Tables) -> DataFrame:
    return event_stream(t).withColumn("at", F.col("ts").cast("timestamp"))


def flat_windows(counts: DataFrame) -> DataFrame:
    start = F.col("window.start").cast("timestamp_ntz").alias("window_start")
    return counts.select(start, *[c for c in counts.columns if c != "window"])


def closed_and_open(t: Tables, name: str, window: str, keys: list[Column], slide: str | None = None) -> DataFrame:
    """Counts per window: closed ones from the stream, those it left open from the rows past its watermark."""
    home = scratch_path(t.spark, name)
    closed = flat_windows(jobs.window_counts(timed_events(t), "at", "10 minutes", window, keys, slide))
    totals = watched(closed, home)
    opened = windows.open_windows(t.events, "ts", totals, window, keys, slide)
    return t.spark.read.schema(closed.schema).parquet(f"{home}/out").unionByName(flat_windows(opened))


@query(
    "i05_streaming_counts",
    f"""WITH {LOG} SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, op, count(*) AS events FROM chg GROUP BY ALL""",
)
def streaming_counts(t: Tables) -> DataFrame:
    """Hourly counts, the last windows included."""
    return closed_and_open(t, "counts", "1 hour", [F.col("event_type"), op_of_event()])


@query(
    "i05_sliding_counts",
    """WITH s AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) - to_minutes(30 * i) + CASE WHEN minute(ts) >= 30 THEN INTERVAL 30 MINUTE ELSE INTERVAL 0 MINUTE END AS window_start
        FROM events, (VALUES (0), (1)) v(i))
    SELECT window_start, event_type, count(*) AS events FROM s GROUP BY ALL""",
)
def sliding_counts(t: Tables) -> DataFrame:
    return closed_and_open(t, "sliding", "1 hour", [F.col("event_type")], slide="30 minutes")


@query(
    "i05_streaming_rates",
    """WITH s AS (SELECT event_type, (CAST(floor(epoch(ts) / 30) AS BIGINT) + 1) * 30 AS "at", count(*) AS n FROM events GROUP BY ALL)
    SELECT event_type, "at", sum(n) OVER five ::BIGINT AS total_300, round(sum(n) OVER five / 300.0, 9) AS rate_300,
      sum(n) OVER thirty ::BIGINT AS total_1800, round(sum(n) OVER thirty / 1800.0, 9) AS rate_1800 FROM s
    WINDOW five AS (PARTITION BY event_type ORDER BY "at" RANGE BETWEEN 270 PRECEDING AND CURRENT ROW),
      thirty AS (PARTITION BY event_type ORDER BY "at" RANGE BETWEEN 1770 PRECEDING AND CURRENT ROW)""",
)
def streaming_rates(t: Tables) -> DataFrame:
    """Rates over 5 and 30 minutes at every step with events, from a live log that lands in four parts."""
    streamed: list[tuple[DataFrame, windows.Totals]] = []

    def run(stream: DataFrame, home: str) -> None:
        timed = stream.withColumn("time", F.col("ts").cast("timestamp"))
        rates = windows.rates(timed, ["event_type"], "time", "10 minutes")
        streamed.append((rates, watched(rates, home)))

    home = in_turn(t, "rates", quarters(t), run)
    rates, totals = streamed[-1]
    rows = t.spark.read.schema(rates.schema).parquet(f"{home}/out")
    rows = rows.unionByName(windows.open_rates(t.events, ["event_type"], "ts", totals))
    return rows.withColumns({c: F.round(c, 9) for c in ("rate_300", "rate_1800")})


@query(
    "i05_streaming_alert",
    """WITH h AS (SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS "at", sum(CAST(value AS DECIMAL(18, 2))) AS total FROM events GROUP BY ALL),
    c AS (SELECT *, total > 40 AS hot, lag(total > 40) OVER w AS before FROM h WINDOW w AS (PARTITION BY event_type ORDER BY "at")),
    i AS (SELECT *, sum(CASE WHEN hot AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY "at") AS island FROM c)
    SELECT event_type, min("at") AS since, max("at") AS until, count(*) AS samples FROM i WHERE hot GROUP BY event_type, island
    HAVING max("at") - min("at") >= 7200""",
)
def streaming_alert(t: Tables) -> DataFrame:
    """``e08_condition_held`` on the live log: hourly sums above a limit for two hours. Heartbeats close the last hours."""
    events = t.events.select("event_type", "value", "ts")
    beat = t.events.agg((F.max("ts") + F.expr("INTERVAL '1' DAY")).alias("ts"))
    beat = beat.select(F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("double").alias("value"), "ts")

    def run(stream: DataFrame, home: str) -> None:
        timed = stream.withColumn("time", F.col("ts").cast("timestamp"))
        rows = windows.without_heartbeats(timed, "time", "10 minutes", F.col("event_type").isNull())
        hours = rows.groupBy(F.window("time", "1 hour").alias("window"), "event_type").agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
        points = hours.select("event_type", F.unix_timestamp("window.start").alias("at"), "total")
        found = windows.held(points, ["event_type"], F.col("total") > 40, 7200)
        table = KeyedTable(t.spark, f"{home}/episodes", ["event_type", "since"], found.schema)
        jobs.each_batch(found, lambda batch, number: table.upsert(batch, number + 1), f"{home}/checkpoint").awaitTermination()

    halves = [events.where("ts < '2024-01-16'"), events.where("ts >= '2024-01-16'")]
    home = in_turn(t, "alert", [*halves, beat], run)
    schema = "event_type string, since bigint, until bigint, samples bigint"
    return KeyedTable(t.spark, f"{home}/episodes", ["event_type", "since"], schema).current()


@query(
    "i06_late_rows",
    """SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS events FROM events WHERE ts >= '2024-01-10' GROUP BY ALL
    UNION ALL SELECT NULL, 'late rows', count(*) FROM events WHERE ts < '2024-01-10'""",
)
def late_rows(t: Tables) -> DataFrame:
    """Days from the tenth on land in two parts, the days before them last: these are dropped, and their number is told."""
    parts = ["ts >= '2024-01-10' AND ts < '2024-01-20'", "ts >= '2024-01-20'", "ts < '2024-01-10'"]
    runs: list[windows.Totals] = []
    schemas = []

    def run(stream: DataFrame, home: str) -> None:
        timed = stream.withColumn("at", F.col("ts").cast("timestamp"))
        closed = flat_windows(jobs.window_counts(timed, "at", "10 minutes", "1 day", [F.col("event_type")]))
        runs.append(watched(closed, home))
        schemas.append(closed.schema)

    home = in_turn(t, "late", [t.events.where(p) for p in parts], run)
    closed = t.spark.read.schema(schemas[0]).parquet(f"{home}/out")
    opened = flat_windows(windows.open_windows(t.events, "ts", runs[-1], "1 day", [F.col("event_type")]))
    total = windows.Totals(rows=sum(r.rows for r in runs))
    late = windows.late_rows(total, closed, opened).select(
        F.lit(None).cast("timestamp_ntz").alias("window_start"), F.lit("late rows").alias("event_type"), F.col("late_rows").alias("events")
    )
    return closed.unionByName(opened).unionByName(late)


@query(
    "i07_latest_state",
    f"""WITH {LOG} SELECT k, max(event_id) AS lsn, arg_max(value, event_id) AS value, arg_max(op, event_id) AS op, count(*) AS changes FROM chg GROUP BY k""",
)
def latest_state(t: Tables) -> DataFrame:
    """Newest image per key as running state, written by key on every change."""
    stream = event_stream(t).select(F.col("user_id").alias("k"), F.col("event_id").alias("lsn"), "value", op_of_event())
    state = jobs.latest_state(stream, ["k"], "lsn", ["value", "op"])
    home = scratch_path(t.spark, "state")
    flat = state.select("k", "lsn", "doc.value", "doc.op", "changes")
    table = KeyedTable(t.spark, f"{home}/state", ["k"], flat.schema)
    jobs.each_batch(
        flat, lambda batch, number: table.upsert(batch, number + 1), f"{home}/checkpoint", mode="update"
    ).awaitTermination()
    return table.current()


@query(
    "i07_streak_state",
    """WITH r AS (SELECT user_id, event_id, value < 20 AS ok, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    s AS (SELECT user_id, event_id, ok, rn - coalesce(max(CASE WHEN NOT ok THEN rn END) OVER w, 0) AS good, rn - coalesce(max(CASE WHEN ok THEN rn END) OVER w, 0) AS bad FROM r
      WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, ok, CASE WHEN ok THEN good ELSE bad END AS length FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""",
)
def streak_state(t: Tables) -> DataFrame:
    """Runs per user in the state store; the log lands in four parts, each read by a new query on the same checkpoint."""
    return tracked(t, "streaks", quarters(t), "user_id bigint, ok boolean, length bigint")


def tracked(t: Tables, name: str, parts: list[DataFrame], schema: str, **options: object) -> DataFrame:
    def run(stream: DataFrame, home: str) -> None:
        state = KeyedTable(t.spark, f"{home}/state", ["user_id"], schema)
        ok = F.col("value") < 20
        jobs.track_streaks(stream, ["user_id"], "event_id", ok, state, f"{home}/checkpoint", **options).awaitTermination()

    home = in_turn(t, name, parts, run)
    return KeyedTable(t.spark, f"{home}/state", ["user_id"], schema).current()


@query(
    "i07_recent_outcomes",
    """WITH m AS (SELECT max(event_id) AS last FROM events),
    again AS (SELECT user_id, count(*) AS repeated FROM events, m, (VALUES (1), (2), (3)) q(k)
      WHERE event_id < last * k // 4 AND event_id >= last * k // 4 - 50 GROUP BY user_id),
    l AS (SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 10)
    SELECT user_id, max(event_id) AS position, count(*) AS recent_rows, round(avg(value), 6) AS recent_mean, coalesce(any_value(repeated), 0) AS repeated
    FROM l LEFT JOIN again USING (user_id) GROUP BY user_id""",
)
def recent_outcomes(t: Tables) -> DataFrame:
    """Mean of each user's last ten values, kept while the log lands in parts that bring 50 positions twice."""
    schema = "user_id bigint, position bigint, recent_rows bigint, recent_sum double, repeated bigint"
    rows = tracked(t, "recent", quarters(t, again=50), schema, value=F.col("value"))
    mean = F.round(F.col("recent_sum") / F.col("recent_rows"), 6).alias("recent_mean")
    return rows.select("user_id", "position", "recent_rows", mean, "repeated")


@query(
    "i07_silent_keys",
    """WITH r AS (SELECT user_id, event_id, ts, value < 20 AS ok, lag(value < 20) OVER w AS ok_before, lag(ts) OVER w AS before FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    b AS (SELECT *, sum(CASE WHEN before IS NULL OR ok <> ok_before OR epoch_ms(ts) - epoch_ms(before) > 86400000 THEN 1 ELSE 0 END)
      OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM r),
    g AS (SELECT user_id, ok, run, count(*) AS length, max(ts) AS last_ts FROM b GROUP BY user_id, ok, run QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY run DESC) = 1),
    s AS (SELECT *, epoch_ms(last_ts) + 86400000 <= (SELECT epoch_ms(max(ts)) FROM events) AS silent FROM g)
    SELECT user_id, ok, CASE WHEN silent THEN 0 ELSE length END AS length, silent FROM s""",
)
def silent_keys(t: Tables) -> DataFrame:
    """A day without events ends a user's run: in the rows that follow, or by a timer once the watermark has passed it."""
    schema = "user_id bigint, ok boolean, length bigint, silent boolean"
    return tracked(t, "silent", quarters(t), schema, ts="ts", idle_seconds=86_400)


@query("i08_backfill_handover", MERGED)
def backfill_handover(t: Tables) -> DataFrame:
    """Full copy as of position 400, then the stream from behind that position."""
    home = scratch_path(t.spark, "handover")
    task = SyncTask("items", "public.items", "items", ("k",))
    target = KeyedTable(t.spark, f"{home}/items", ["k"], t.snapshot.schema)
    early = t.log.where("event_id <= 400").select("k", "value", "props", F.col("op").alias(OP), F.col("event_id").alias(LSN))
    as_of_400 = KeyedTable(t.spark, f"{home}/copy", ["k"], t.snapshot.schema)
    as_of_400.write_base(t.snapshot)
    as_of_400.write_batch(early, 1)
    jobs.full_copy(as_of_400.current(), task, target)
    jobs.apply_changes(change_stream(t), task, target, f"{home}/checkpoint", start_after=400).awaitTermination()
    return target.current()


@query(
    "a15_schema_change",
    f"""WITH {LOG}, m AS (SELECT max(event_id) AS last FROM events),
    last AS (SELECT *, CASE WHEN event_id >= last * 2 // 3 THEN 3 WHEN event_id >= last // 3 THEN 2 ELSE 1 END AS version FROM chg, m
      QUALIFY row_number() OVER (PARTITION BY k ORDER BY event_id DESC) = 1)
    SELECT k AS id, CASE WHEN version < 3 THEN event_type END AS kind, CASE WHEN version > 1 THEN value END AS amount,
      CASE WHEN version = 3 THEN props END AS note FROM last WHERE op <> 'delete'""",
)
def schema_change(t: Tables) -> DataFrame:
    """While the log runs a column is added, another is dropped, and the key's type is widened; each part is merged as it lands."""
    column = lambda name, kind: F.struct(F.lit(name).alias("name"), F.lit(pgtypes.OIDS[kind]).alias("type_id"))
    shapes = [
        [("id", "int4"), ("kind", "text")],
        [("id", "int4"), ("kind", "text"), ("amount", "float8")],
        [("id", "int8"), ("amount", "float8"), ("note", "text")],
    ]
    last = t.events.agg(F.max("event_id")).first()[0] or 0
    cuts = [0, last // 3, last * 2 // 3, last + 1]
    versions = [
        t.spark.range(1).select(F.lit(1).alias("relation_id"), F.lit(a).cast("bigint").alias(LSN), F.array(*[column(*c) for c in shape]).alias("columns"))
        for a, shape in zip(cuts[:-1], shapes, strict=True)
    ]
    texts = {"id": F.col("user_id").cast("string"), "kind": F.col("event_type"), "amount": F.col("value").cast("string"), "note": F.col("props")}
    parts = [
        t.events.where(f"event_id >= {a} AND event_id < {b}").select(
            F.lit(1).alias("relation_id"), op_of_event().alias(OP), F.col("event_id").alias(LSN), F.col("ts").alias("__ts"),
            F.array(*[texts[name] for name, _ in shape]).alias("tuple"),
        )
        for a, b, shape in zip(cuts[:-1], cuts[1:], shapes, strict=True)
    ]
    task = SyncTask("items", "public.items", "items", ("id",))
    tables: list[KeyedTable] = []

    def run(stream: DataFrame, home: str) -> None:
        known = reduce(DataFrame.unionByName, versions[: len(tables) + 1])
        rows = evolution.evolving_rows(stream, known, "relation_id", LSN).drop("relation_id")
        schema = evolution.row_schema(rows, [c for c in rows.columns if not c.startswith("__")])
        if tables:
            tables.append(evolution.evolved(tables[-1], schema))
        else:
            tables.append(KeyedTable(t.spark, f"{home}/items", ["id"], schema))
        jobs.apply_changes(rows, task, tables[-1], f"{home}/checkpoint").awaitTermination()

    in_turn(t, "evolving", parts, run)
    return tables[-1].current()


@query("i08_copy_beside_log", MERGED)
def copy_beside_log(t: Tables) -> DataFrame:
    """The log is applied from its start while the table is copied in ranges of keys, two after each part that has landed.

    A range is read forty changes after the position it is stored at: these are in the range and come in the log as well.
    """
    task = SyncTask("items", "public.items", "items", ("k",))
    ranges = jobs.key_ranges(t.snapshot, "k", 8)
    changes = t.log.select("k", "value", "props", F.col("op").alias(OP), F.col("event_id").alias(LSN))
    last = t.events.agg(F.max("event_id")).first()[0] or 0
    turns = iter(enumerate([*[last * k // 4 - 1 for k in (1, 2, 3)], last]))

    def run(stream: DataFrame, home: str) -> None:
        target = KeyedTable(t.spark, f"{home}/items", ["k"], t.snapshot.schema)
        rows = stream.select(op_of_event().alias(OP), F.col("event_id").alias(LSN), F.col("ts").alias("__ts"), F.col("user_id").alias("k"), "value", "props")
        jobs.apply_changes(rows, task, target, f"{home}/checkpoint", compact_every=None).awaitTermination()
        turn, landed = next(turns)
        table = merge.fan_in(t.snapshot, changes.where(F.col(LSN) <= landed + 40), ["k"], [LSN])
        jobs.copy_beside(table.where, ranges[: 2 * turn + 2], task, target, lambda: landed, start=2 * turn)

    home = in_turn(t, "beside", quarters(t), run)
    return KeyedTable(t.spark, f"{home}/items", ["k"], t.snapshot.schema).current()


@query(
    "i01_row_batches",
    """WITH m AS (SELECT max(event_id) AS last FROM events),
    q AS (SELECT event_id, CASE WHEN event_id >= last * 3 // 4 THEN 3 WHEN event_id >= last * 2 // 4 THEN 2 WHEN event_id >= last // 4 THEN 1 ELSE 0 END AS part FROM events, m),
    b AS (SELECT part, event_id, (row_number() OVER (PARTITION BY part ORDER BY event_id) - 1) // 1000 AS piece FROM q)
    SELECT row_number() OVER (ORDER BY part, piece) - 1 AS batch_number, count(*) AS rows, min(event_id) AS first_position, max(event_id) AS last_position
    FROM b GROUP BY part, piece""",
)
def row_batches(t: Tables) -> DataFrame:
    """The log in batches of 1000 rows at most; a batch also ends with what has landed when it is read."""

    def run(stream: DataFrame, home: str) -> None:
        jobs.row_batches(stream, "event_id", f"{home}/out", f"{home}/checkpoint", segment=SEGMENT).awaitTermination()

    return jobs.batch_list(t.spark, f"{in_turn(t, 'rows', quarters(t), run)}/out", "event_id")


def coded_stream(t: Tables) -> DataFrame:
    code = F.when(F.col("value") > 100, F.col("props")).otherwise(F.col("value").cast("string"))
    return change_stream(t).withColumn("code", code).drop("value", "props")


def run_coded(t: Tables, name: str):
    home = scratch_path(t.spark, name)
    target = KeyedTable(t.spark, f"{home}/items", ["k"], "k bigint, code double")
    letters = DeadLetterTable(t.spark, f"{home}/dead")
    progress = KeyedTable(t.spark, f"{home}/progress", ["task_id"], jobs.PROGRESS_SCHEMA)
    query = jobs.apply_changes(coded_stream(t), LOG_TASK, target, f"{home}/checkpoint", letters, progress)
    query.awaitTermination()
    return target, letters, progress


@query(
    "i09_dead_letter_branch",
    f"""WITH {LOG}, good AS (SELECT * FROM chg WHERE value <= 100 QUALIFY row_number() OVER (PARTITION BY k ORDER BY event_id DESC) = 1)
    SELECT 'item' AS kind, k, CAST(value AS VARCHAR) AS detail FROM good WHERE op <> 'delete'
    UNION ALL SELECT 'dead', k, '''' || props || ''' is no number' FROM chg WHERE value > 100""",
)
def dead_letter_branch(t: Tables) -> DataFrame:
    target, letters, _ = run_coded(t, "branch")
    items = target.current().select(F.lit("item").alias("kind"), "k", F.col("code").cast("string").alias("detail"))
    failed = letters.read().select(
        F.lit("dead").alias("kind"), F.get_json_object("event", "$.k").cast("bigint").alias("k"), F.col("error").alias("detail")
    )
    return items.unionByName(failed)


@query(
    "i10_progress_rows",
    f"""WITH {LOG} SELECT 'items' AS task_id, 'default' AS source_name, CAST(0 AS BIGINT) AS batch_id, max(event_id) AS position,
      count(CASE WHEN value <= 100 THEN 1 END) AS events_processed, count(CASE WHEN value > 100 THEN 1 END) AS events_failed, max(ts) AS last_event_at,
      count(CASE WHEN value <= 100 THEN 1 END) AS total_processed, count(CASE WHEN value > 100 THEN 1 END) AS total_failed FROM chg""",
)
def progress_rows(t: Tables) -> DataFrame:
    return run_coded(t, "progress")[2].current()


@query(
    "a25_edit_between_batches",
    f"""WITH {LOG} SELECT k, event_id AS position FROM chg WHERE value > 100 AND (event_id >= 300 OR event_id % 2 = 1)""",
)
def edit_between_batches(t: Tables) -> DataFrame:
    """An operator removes dead letters between two batches of a stream, and the table is compacted: both stay."""
    code = F.when(F.col("value") > 100, F.col("props")).otherwise(F.col("value").cast("string"))
    rows = change_events(t).withColumns({"code": code, "position": F.col(LSN)}).drop("__table", "__schema", "value", "props")
    home, stream = landed(t, "edits", rows.where("__lsn < 300"))
    target = KeyedTable(t.spark, f"{home}/items", ["k"], "k bigint, code double")
    letters = DeadLetterTable(t.spark, f"{home}/dead")
    position = F.get_json_object("event", "$.position").cast("bigint")
    for part in (None, rows.where("__lsn >= 300")):
        if part is not None:
            letters.remove(letters.read().where(position % 2 == 0))
            letters.table.compact()
            part.write.mode("append").parquet(f"{home}/landing")
        jobs.apply_changes(stream, LOG_TASK, target, f"{home}/checkpoint", letters).awaitTermination()
    return letters.read().select(F.get_json_object("event", "$.k").cast("bigint").alias("k"), position.alias("position"))


@query(
    "i10_filtered_batch",
    f"""WITH {LOG} SELECT 'items' AS task_id, CAST(1 AS BIGINT) AS batch_id, max(event_id) AS position, CAST(0 AS BIGINT) AS events_processed,
      max(ts) AS last_event_at, count(CASE WHEN event_id < 300 THEN 1 END) AS total_processed FROM chg""",
)
def filtered_batch(t: Tables) -> DataFrame:
    """A batch whose rows are all filtered out moves the position on and keeps the totals."""
    rows = change_events(t).withColumn("n", F.col(LSN)).drop("__table", "__schema")
    only = EventFilter(conditions=(Condition("less_than", "n", 300),))
    task = SyncTask("items", "items", "items", ("k",), filter=only)

    def run(stream: DataFrame, home: str) -> None:
        target = KeyedTable(t.spark, f"{home}/items", ["k"], "k bigint, value double")
        progress = KeyedTable(t.spark, f"{home}/progress", ["task_id"], jobs.PROGRESS_SCHEMA)
        jobs.apply_changes(stream, task, target, f"{home}/checkpoint", progress=progress).awaitTermination()

    home = in_turn(t, "filtered", [rows.where("__lsn < 300"), rows.where("__lsn >= 300")], run)
    progress = KeyedTable(t.spark, f"{home}/progress", ["task_id"], jobs.PROGRESS_SCHEMA)
    return progress.current().select("task_id", "batch_id", "position", "events_processed", "last_event_at", "total_processed")
