"""Change streams: reading, counting, applying and reporting progress."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from driftline.config import SyncTask
from driftline.operators import ERRORS, LSN, OP, SCHEMA, TABLE, deadletters
from driftline.operators.dedup import stream_first_seen
from driftline.operators.merge import latest_per_key
from driftline.operators.ordered import LOG_SEGMENT, batch_numbers, log_chunk, numbered
from driftline.plans.sync import Outcome, run_task
from driftline.sources.deadletter_table import DeadLetterTable
from driftline.sources.keyed_table import KeyedTable
from driftline.streaming import keyed

# Fixed value: how long a batch waits for more rows by default.
BATCH_INTERVAL = "1 second"

# What tells deliveries apart, next to the key of the row.
DELIVERY_COLUMNS = (LSN, "__xid", TABLE)
DEDUP_DELAY = "10 minutes"

# Batches between two compactions of the tables a stream writes.
COMPACT_EVERY = 100


def read_log(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "parquet",
    glob: str | None = None,
    max_files: int | None = None,
    max_bytes: str | None = None,
    spread: bool = False,
) -> DataFrame:
    """Landed log files as a stream; ``max_files`` or ``max_bytes`` bound a micro-batch.

    A file of one row group is read in one task, however large. ``spread`` deals the rows of a
    micro-batch out evenly, where what is done with each costs far more than to move it (decoding).
    """
    reader = spark.readStream.format(fmt).schema(schema)
    limits = {"pathGlobFilter": glob, "maxFilesPerTrigger": max_files, "maxBytesPerTrigger": max_bytes}
    for key, value in limits.items():
        if value is not None:
            reader = reader.option(key, value)
    rows = reader.load(path)
    if not spread:
        return rows
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def trigger_options(once: bool, interval: str = BATCH_INTERVAL) -> Mapping[str, object]:
    """Drain what is there and stop, or run on at an interval."""
    return {"availableNow": True} if once else {"processingTime": interval}


def window_counts(
    stream: DataFrame, ts: str, delay: str, window: str, keys: Sequence[Column], slide: str | None = None
) -> DataFrame:
    """Events per time window and key; rows later than ``delay`` are dropped and counted by Spark."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.window(ts, window, slide or window).alias("window"), *keys)
        .agg(F.count(F.lit(1)).alias("events"))
    )


def latest_state(stream: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Newest image per key as running state; partial results keep a hot key small."""
    image = F.max_by(F.struct(*columns), F.col(order))
    return stream.groupBy(*keys).agg(image.alias("doc"), F.max(order).alias(order), F.count(F.lit(1)).alias("changes"))


def write_stream(
    df: DataFrame, path: str, checkpoint: str, once: bool = True, partition_by: Sequence[str] = (), **trigger: str
) -> StreamingQuery:
    """Append a stream to files, exactly once."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.trigger(**trigger_options(once, **trigger)).start(path)


def each_batch(
    df: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    once: bool = True,
    mode: str = "append",
    **trigger: str,
) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger_options(once, **trigger)).start()


def progress_rows(
    rows: DataFrame, task: SyncTask, batch_id: int, ts: str, failed: Column, read: DataFrame, earlier: DataFrame
) -> DataFrame:
    """One progress row of a micro-batch.

    Position and time are those of all rows that were ``read``, filtered ones included; a batch that
    read none keeps the ``earlier`` row's. Totals go on from the earlier row.
    """
    seen = read.agg(F.max(LSN).alias("__position"), F.max(ts).cast("timestamp_ntz").alias("__at"))
    done = rows.agg(F.count_if(~failed).alias("events_processed"), F.count_if(failed).alias("events_failed"))
    names = {"task_id": F.lit(task.id)}
    before = earlier.where(F.col("task_id") == task.id).select(
        "task_id", *[F.col(c).alias(f"__{c}") for c in ("position", "last_event_at", "total_processed", "total_failed")]
    )
    row = seen.withColumns(names).join(done.withColumns(names), "task_id").join(before.withColumnRenamed("__position", "__old"), "task_id", "left")
    total = lambda c: F.coalesce(F.col(f"__total_{c}"), F.lit(0)) + F.col(f"events_{c}")
    return row.select(
        "task_id",
        F.lit(task.source_name).alias("source_name"),
        F.lit(batch_id).cast("bigint").alias("batch_id"),
        F.coalesce(F.greatest("__position", "__old"), "__position", "__old").alias("position"),
        "events_processed",
        "events_failed",
        F.coalesce(F.greatest("__at", "__last_event_at"), "__at", "__last_event_at").alias("last_event_at"),
        total("processed").alias("total_processed"),
        total("failed").alias("total_failed"),
    )


PROGRESS_SCHEMA = (
    "task_id string, source_name string, batch_id bigint, position bigint,"
    " events_processed bigint, events_failed bigint, last_event_at timestamp_ntz,"
    " total_processed bigint, total_failed bigint"
)


@dataclass(frozen=True)
class Route:
    """A task and where its rows go."""

    task: SyncTask
    target: KeyedTable
    dead_letters: DeadLetterTable | None = None
    progress: KeyedTable | None = None

    @property
    def tables(self) -> list[KeyedTable]:
        letters = [self.dead_letters.table] if self.dead_letters else []
        return [self.target, *letters, *([self.progress] if self.progress else [])]


def writer_name(checkpoint: str, task: SyncTask) -> str:
    """A stream's name among the writers of a table: its checkpoint and task tell it from every other."""
    return hashlib.sha256(f"{checkpoint.rstrip('/')}\n{task.id}".encode()).hexdigest()[:12]


def own_rows(rows: DataFrame, task: SyncTask, unnamed: bool = False) -> DataFrame:
    """Rows of the task's table, registered as ``schema.table`` or as ``table``; all rows of a log without table names.

    ``unnamed`` adds the rejected lines that name no table.
    """
    return rows.where(_owned(rows.columns, task, unnamed))


def _owned(columns: Sequence[str], task: SyncTask, unnamed: bool) -> Column:
    if TABLE not in columns or not task.table:
        return F.lit(True)
    schema, _, table = task.table.rpartition(".")
    mine = F.col(TABLE) == table
    if schema and SCHEMA in columns:
        mine = mine & (F.col(SCHEMA) == schema)
    if unnamed and ERRORS in columns:
        mine = mine | (F.col(TABLE).isNull() & (F.size(ERRORS) > 0))
    return mine


def with_key_errors(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds an error to rows that lack a part of their key: they cannot be stored or found again."""
    known = F.col(ERRORS) if ERRORS in rows.columns else F.array().cast("array<string>")
    lacking = [F.when(F.col(f"`{k}`").isNull() if k in rows.columns else F.lit(True), F.lit(f"No value for key field {k}")) for k in keys]
    return rows.withColumn(ERRORS, F.concat(F.coalesce(known, F.array().cast("array<string>")), F.array_compact(F.array(*lacking))))


def apply_changes(
    stream: DataFrame,
    task: SyncTask,
    target: KeyedTable,
    checkpoint: str,
    dead_letters: DeadLetterTable | None = None,
    progress: KeyedTable | None = None,
    ts: str = "__ts",
    start_after: int | None = None,
    once: bool = True,
    compact_every: int | None = COMPACT_EVERY,
) -> StreamingQuery:
    """Run a task over a change stream and keep ``target`` up to date; see :func:`apply_log`."""
    return apply_log(stream, [Route(task, target, dead_letters, progress)], checkpoint, ts, start_after, once, compact_every)


def apply_log(
    stream: DataFrame,
    routes: Sequence[Route],
    checkpoint: str,
    ts: str = "__ts",
    start_after: int | None = None,
    once: bool = True,
    compact_every: int | None = COMPACT_EVERY,
) -> StreamingQuery:
    """Run many tasks over one change stream, which is read once, and keep their targets up to date.

    A task takes the rows of its own table; rows of tables without a task are dropped, and lines
    that could not be read at all become dead letters of the first task that keeps any. Every table
    a batch writes stores it under this stream's name and the batch id, and the offsets are
    committed after that: a batch that is run again after a failure replaces what it wrote before.
    Rows that lack their key are rejected. With ``start_after`` the stream continues behind a full
    copy taken at that position. Every ``compact_every`` batches the earlier ones are folded into a
    new base. Repeated deliveries are dropped where a task asks for it, for a time after they
    first arrived; how old a change is does not matter. Tasks that do not ask keep all their rows, and
    rows that cannot be told apart (failed before, or without position or key) are never dropped;
    for these the log is read a second time.
    """
    writers = [writer_name(checkpoint, r.task) for r in routes]
    catch_all = next((i for i, r in enumerate(routes) if r.dead_letters), None)
    if start_after is not None:
        stream = stream.where(F.col(LSN) > F.lit(start_after))
    decided = [_decided(stream.columns, r.task) for r in routes]
    repeats = any(r.task.options.get("deduplicate") for r in routes)
    if repeats:
        stream = _first_deliveries(stream, routes, catch_all, ts)

    def handle(batch: DataFrame, batch_id: int) -> None:
        # Batch 0 of the stream is batch 1 of the tables, behind the base version 0.
        number = batch_id + 1
        for route, writer in zip(routes, writers, strict=True):
            for table in route.tables:
                table.compact_every(compact_every, table.place_of(number, writer))
        # The batch feeds several writes. Lost cached blocks are computed again from its files.
        batch = batch.persist()
        try:
            for i, route in enumerate(routes):
                rows = own_rows(batch, route.task, i == catch_all)
                if repeats:
                    rows = rows.where(F.col("__decided") == decided[i]).drop("__decided")
                _apply(rows, route, number, writers[i], ts)
        finally:
            batch.unpersist()

    waits = [r.task.options.get("batch_timeout_ms") for r in routes if r.task.options.get("batch_timeout_ms")]
    return each_batch(stream, handle, checkpoint, once, interval=f"{min(waits)} milliseconds" if waits else BATCH_INTERVAL)


def _decided(columns: Sequence[str], task: SyncTask) -> Column:
    """Whether the task wants the row told from repeated deliveries, and the row has what tells it."""
    if not task.options.get("deduplicate"):
        return F.lit(False)
    known = F.lit(True)
    for c in (LSN, *(k for k in task.primary_key if k in columns)):
        known = known & F.col(f"`{c}`").isNotNull() if c in columns else known
    return known & (F.coalesce(F.size(ERRORS), F.lit(0)) <= 0) if ERRORS in columns else known


def _first_deliveries(stream: DataFrame, routes: Sequence[Route], catch_all: int | None, ts: str) -> DataFrame:
    """Adds ``__decided``: the first deliveries of rows that a task wants told from repeated ones (true), and
    next to them all rows of which a task takes every delivery (false). A row can be in both."""
    asked, rest = F.lit(False), F.lit(False)
    for i, route in enumerate(routes):
        own = F.coalesce(_owned(stream.columns, route.task, i == catch_all), F.lit(False))
        sound = _decided(stream.columns, route.task)
        asked, rest = asked | (own & sound), rest | (own & ~sound)
    repeated = [r.task for r in routes if r.task.options.get("deduplicate")]
    keys = [c for c in DELIVERY_COLUMNS if c in stream.columns]
    parts = sorted({k for task in repeated for k in _row_keys(stream, task)})
    # The time of arrival, which never lags behind the watermark: a late change is no repeated one.
    timed = stream.where(asked).withColumn("__seen", F.current_timestamp())
    if any(k not in stream.columns for task in repeated for k in task.primary_key):
        # A key that the task makes itself: rows of one position are told apart by all they hold.
        held = F.struct(*[F.col(f"`{c}`") for c in stream.columns if c not in (ts, ERRORS)])
        timed, parts = timed.withColumn("__row", F.sha2(F.to_json(held), 256)), [*parts, "__row"]
    delay = _longest(stream.sparkSession, [str(t.options.get("deduplicate_within", DEDUP_DELAY)) for t in repeated])
    first = stream_first_seen(timed, [*keys, *parts], "__seen", delay).select(*[F.col(f"`{c}`") for c in stream.columns])
    return first.withColumn("__decided", F.lit(True)).unionByName(stream.where(rest).withColumn("__decided", F.lit(False)))


def _longest(spark: SparkSession, delays: Sequence[str]) -> str:
    """The longest of some interval texts."""
    texts = sorted(set(delays))
    if len(texts) == 1:
        return texts[0]
    start = F.lit("2000-01-01 00:00:00").cast("timestamp")
    ends = spark.range(1).select(*[F.unix_micros(start + F.lit(d).cast("interval")) for d in texts]).first()
    return max(zip(ends, texts, strict=True))[1]


def _apply(read: DataFrame, route: Route, number: int, writer: str, ts: str) -> None:
    """One task's share of a micro-batch into its tables."""
    task = route.task
    good = read
    if ERRORS in read.columns:  # rows that failed before take no part in filters
        good = read.where(F.size(ERRORS) == 0)
    rows = with_key_errors(run_task(good, task).all_rows, route.target.keys)
    if ERRORS in read.columns:
        rows = rows.unionByName(read.where(F.size(ERRORS) > 0), allowMissingColumns=True).select(*rows.columns)
    rows = rows.persist()
    try:
        done = Outcome(rows)
        route.target.write_batch(done.accepted, number, writer)
        if route.dead_letters is not None:
            at = F.col(ts) if ts in rows.columns else None
            entries = deadletters.entries(done.rejected, F.lit(task.id), at, identity=F.coalesce(F.col(LSN).cast("string"), "event"))
            route.dead_letters.store(entries, number, writer)
        if route.progress is not None:
            earlier = route.progress.as_of(route.progress.place_of(number, writer) - 1)
            bad = F.size(ERRORS) > 0
            route.progress.upsert(progress_rows(rows, task, number - 1, ts, bad, read, earlier), number, writer)
    finally:
        rows.unpersist()


def _row_keys(stream: DataFrame, task: SyncTask) -> list[str]:
    """Key fields of a task that the stream itself has (a mapping may make the others)."""
    return [c for c in task.primary_key if c in stream.columns]


def full_copy(table: DataFrame, task: SyncTask, target: KeyedTable, clock: Column | None = None) -> None:
    """Initial copy of a table through the task, as base version 0."""
    target.write_base(run_task(table, task, full_sync=True, clock=clock).accepted, 0)


# --- a copy beside the running log ----------------------------------------------------------


def copy_beside(
    read: Callable[[Column], DataFrame],
    ranges: Sequence[Column],
    task: SyncTask,
    target: KeyedTable,
    position: Callable[[], int],
    writer: str = "copy",
    start: int = 0,
) -> None:
    """Copy a table range by range while streams apply its log to ``target``.

    ``ranges`` are conditions that together hold every key once. Before a range is read, ``position`` tells how
    far the log goes; the range, read some time after, is stored at that position. What the log
    says about its keys behind that position wins, whether a stream applies it before or after, and
    what it said earlier is in the range already. A range that is copied again replaces itself, so
    a copy that broke off goes on with ``start``. While it runs, ``target`` must not be compacted (streams with
    ``compact_every=None``): a base does not know of keys that were deleted behind the position of a range.
    """
    for number, condition in enumerate(ranges):
        if number < start:
            continue
        low = position()
        rows = run_task(read(condition), task, full_sync=True).accepted
        target.write_batch(rows.withColumns({OP: F.lit("create"), LSN: F.lit(low).cast("bigint")}), number + 1, writer)


def key_ranges(table: DataFrame, key: str, number: int) -> list[Column]:
    """Conditions that cut a table into about ``number`` ranges of one key of like size; null keys are in the first."""
    shares = [i / number for i in range(1, number)]
    found = table.agg(F.percentile_approx(key, F.array(*map(F.lit, shares)), 10_000).alias("cuts")).first()["cuts"] if shares else []
    cuts = sorted(set(found or []))
    column = F.col(f"`{key}`")
    if not cuts:
        return [F.lit(True)]
    between = [(column >= F.lit(a)) & (column < F.lit(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [(column < F.lit(cuts[0])) | column.isNull(), *between, column >= F.lit(cuts[-1])]


# --- batches of rows ------------------------------------------------------------------------

# Fixed value: rows of a batch by default.
BATCH_ROWS = 1000


def row_batches(
    stream: DataFrame, order: str, path: str, checkpoint: str, size: int = BATCH_ROWS, segment: int = LOG_SEGMENT, once: bool = True, **trigger: str
) -> StreamingQuery:
    """Store a stream cut into batches of at most ``size`` rows in log order: a batch ends when it is full, or with its micro-batch.

    The trigger's interval bounds how long rows wait. Rows go below ``path``, one folder per micro-batch, with
    ``__piece``, the number of the batch in it; a micro-batch that is run again replaces its folder.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("__all", F.lit(True))
        rows = batch_numbers(rows, ["__all"], [order], log_chunk(F.col(order), segment), size, "__piece").drop("__all")
        rows.write.mode("overwrite").parquet(f"{path}/__micro={batch_id}")

    return each_batch(stream, handle, checkpoint, once, **trigger)


def batch_list(spark: SparkSession, path: str, order: str) -> DataFrame:
    """The batches below ``path``: number from 0, rows, first and last position."""
    pieces = spark.read.parquet(path).groupBy("__micro", "__piece").agg(
        F.count(F.lit(1)).alias("rows"), F.min(order).alias("first_position"), F.max(order).alias("last_position")
    )
    pieces = pieces.withColumns({"__all": F.lit(True), "__micro": F.col("__micro").cast("bigint")})
    listed = numbered(pieces, ["__all"], ["__micro", "__piece"], F.col("__micro"), "__rn")
    return listed.select((F.col("__rn") - 1).alias("batch_number"), "rows", "first_position", "last_position")


# --- streaks --------------------------------------------------------------------------------


def track_streaks(
    stream: DataFrame,
    keys: Sequence[str],
    order: str,
    success: Column,
    state: KeyedTable,
    checkpoint: str,
    compact_every: int | None = COMPACT_EVERY,
    **options: object,
) -> StreamingQuery:
    """Keep success and failure streaks per key in ``state`` (keys and any columns of :func:`keyed.streaks`).

    The runs live in the state store; ``state`` is only written to, with the keys of the batch.
    """
    rows = keyed.streaks(stream, keys, order, success, **options).select(*state.schema.fieldNames())

    def handle(batch: DataFrame, batch_id: int) -> None:
        number = batch_id + 1
        state.compact_every(compact_every, number)
        state.upsert(batch, number)

    return each_batch(rows, handle, checkpoint, mode="update")


def compacted(changes: DataFrame, keys: Sequence[str], order: str = LSN) -> DataFrame:
    """Batch twin of :func:`latest_state`: last live change per key."""
    return latest_per_key(changes, keys, [order]).where(F.col(OP) != "delete")
