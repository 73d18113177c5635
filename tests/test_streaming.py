"""Streams drained in several batches give what the batch plans give, also after a restart."""

import random
from collections import Counter
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from driftline.config import Convert, Rename, SyncTask, Transforms
from driftline.operators import LSN, OP, dedup, merge, metrics
from driftline.operators.ordered import log_chunk, streaks
from driftline.plans import alerts
from driftline.sources import changelog
from driftline.sources.deadletter_table import DeadLetterTable
from driftline.sources.keyed_table import KeyedTable
from driftline.streaming import jobs, windows

SCHEMA = "k bigint, v string, code string, __op string, __lsn bigint, __ts timestamp_ntz"
TASK = SyncTask("t", "public.t", "t", ("k",), transform=Transforms(fields=(Convert("code", "number"),)))
ROW = "k bigint, v string, code double"


@pytest.fixture
def landing(spark, folder):
    """Six files of a log over few keys; a tenth of the codes is not a number."""
    log = spark.range(600).select(
        F.expr("CASE WHEN id % 3 = 0 THEN 0 ELSE id * 7 % 11 END").alias("k"),
        F.concat(F.lit("v"), "id").alias("v"),
        F.expr("CASE WHEN id % 10 = 3 THEN 'bad' ELSE cast(id AS string) END").alias("code"),
        F.expr("CASE WHEN id % 13 = 0 THEN 'delete' WHEN id % 2 = 0 THEN 'create' ELSE 'update' END").alias(OP),
        F.col("id").alias(LSN),
        F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)").alias("__ts"),
    )
    path = f"{folder}/landing"
    for i in range(6):
        log.where(F.col(LSN).between(i * 100, i * 100 + 99)).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path):
    return jobs.read_log(spark, path, spark.read.parquet(path).schema, max_files=1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def expected(spark, path, base):
    good = spark.read.parquet(path).where("code <> 'bad'").drop("__ts").withColumn("code", F.col("code").cast("double"))
    return rows(merge.fan_in(base, good, ["k"], [LSN]))


def test_apply(spark, landing, folder):
    base = spark.createDataFrame([(0, "base", 1.0), (77, "kept", 2.0)], ROW)
    target = KeyedTable(spark, f"{folder}/t", ["k"], ROW)
    target.write_base(base)
    dead = DeadLetterTable(spark, f"{folder}/d")
    progress = KeyedTable(spark, f"{folder}/p", ["task_id"], jobs.PROGRESS_SCHEMA)
    for _ in range(2):
        query = jobs.apply_changes(stream(spark, landing), TASK, target, f"{folder}/c", dead, progress, compact_every=2)
        query.awaitTermination()
    assert rows(target.current()) == expected(spark, landing, base)
    assert target.last_batch() == 6 and target.version() == 4 and dead.read().count() == 60
    found = progress.current().first()
    assert (found.batch_id, found.position, found.events_processed, found.events_failed) == (5, 599, 90, 10)


def test_lost_checkpoint_applies_nothing_twice(spark, landing, folder):
    """Without its checkpoint the stream runs all batches again, over the same batch ids."""
    target = KeyedTable(spark, f"{folder}/t", ["k"], ROW)
    dead = DeadLetterTable(spark, f"{folder}/d")
    for i in range(2):
        jobs.apply_changes(stream(spark, landing), TASK, target, f"{folder}/c{i}", dead).awaitTermination()
    assert rows(target.current()) == expected(spark, landing, spark.createDataFrame([], ROW))
    assert dead.read().count() == 60


def test_handover(spark, landing, folder):
    log = spark.read.parquet(landing)
    everything = expected(spark, landing, spark.createDataFrame([], ROW))
    early = log.where(f"{LSN} <= 250 AND code <> 'bad'").drop("__ts").withColumn("code", F.col("code").cast("double"))
    copy = merge.fan_in(spark.createDataFrame([], ROW), early, ["k"], [LSN])
    target = KeyedTable(spark, f"{folder}/t", ["k"], ROW)
    jobs.full_copy(copy.withColumn("code", F.col("code").cast("string")), TASK, target)
    jobs.apply_changes(stream(spark, landing), TASK, target, f"{folder}/c", start_after=250).awaitTermination()
    assert rows(target.current()) == everything


def test_deduplicating_task(spark, landing, folder):
    """The same files landed twice: progress counts every change once."""
    again = f"{folder}/again"
    for _ in range(2):
        spark.read.parquet(landing).coalesce(1).write.mode("append").parquet(again)
    target = KeyedTable(spark, f"{folder}/t", ["k"], ROW)
    progress = KeyedTable(spark, f"{folder}/p", ["task_id"], jobs.PROGRESS_SCHEMA)
    task = replace(TASK, options={"deduplicate": True, "deduplicate_within": "1 hour", "batch_timeout_ms": 500})
    jobs.apply_changes(stream(spark, again), task, target, f"{folder}/c", progress=progress).awaitTermination()
    assert rows(target.current()) == expected(spark, landing, spark.createDataFrame([], ROW))
    seen = spark.read.parquet(f"{folder}/p/changes")
    assert seen.agg(F.sum(F.col("events_processed") + F.col("events_failed"))).first()[0] == 600


LOG = "k bigint, m bigint, v string, __table string, __op string, __lsn bigint, __ts timestamp_ntz, __errors array<string>"


def test_dedup_for_the_tasks_that_ask(spark, folder):
    """Only tasks that ask lose deliveries, only repeated ones, and no rejected row vanishes."""
    put = lambda k, m, v, table, lsn, errors=(): (k, m, v, table, "create", lsn, None, list(errors))
    bad = ["Missing position"]
    log = [put(1, None, "x", "a", 1), put(2, None, "x", "a", 1), put(9, None, "p", "a", None, bad), put(9, None, "q", "a", None, bad)]
    log += [put(None, m, "y", "b", 5) for m in (1, 2, 3)] + [put(None, m, "z", "c", 6) for m in (1, 2)]
    log += [put(None, None, text, None, None, ["Cannot decode change line"]) for text in ("l1", "l2")]
    for _ in range(2):
        spark.createDataFrame(log, LOG).coalesce(1).write.mode("append").parquet(f"{folder}/log")
    ask = {"deduplicate": True}
    renamed = Transforms(fields=(Rename("m", "id"),))
    tasks = [
        SyncTask("a", "a", "a", ("k",), options=ask | {"deduplicate_within": "1 hour"}),
        SyncTask("b", "b", "b", ("m",)),
        SyncTask("c", "c", "c", ("id",), transform=renamed, options=ask),
        SyncTask("every-a", "a", "a", ("k",)),
    ]
    progress = KeyedTable(spark, f"{folder}/p", ["task_id"], jobs.PROGRESS_SCHEMA)
    dead = DeadLetterTable(spark, f"{folder}/d")
    routes = []
    for t in tasks:
        key = t.primary_key[0]
        target = KeyedTable(spark, f"{folder}/{t.id}", [key], f"{key} bigint, v string")
        routes.append(jobs.Route(t, target, dead if t.id == "a" else None, progress))
    jobs.apply_log(stream(spark, f"{folder}/log"), routes, f"{folder}/checkpoint").awaitTermination()
    found = {r["task_id"]: (r["total_processed"], r["total_failed"]) for r in progress.current().collect()}
    # Rejected rows are counted at every delivery; each is one dead letter.
    assert found == {"a": (2, 8), "b": (6, 0), "c": (2, 0), "every-a": (4, 4)}
    assert dead.read().count() == 4
    kept = {r.task.id: sorted(x[0] for x in r.target.current().collect()) for r in routes}
    assert kept == {"a": [1, 2], "b": [1, 2, 3], "c": [1, 2], "every-a": [1, 2]}


def test_longest_delay(spark):
    assert jobs._longest(spark, ["10 minutes", "1 hour", "90 seconds"]) == "1 hour"
    assert jobs._longest(spark, ["7 days", "1 month", "10 minutes"]) == "1 month"


def test_dedup_across_batches(spark, landing, folder):
    twice = stream(spark, landing).withColumn("__ts", F.col("__ts").cast("timestamp"))
    twice = twice.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    out = dedup.stream_first_seen(twice, [LSN], "__ts", "10 minutes").select(LSN)
    jobs.write_stream(out, f"{folder}/o", f"{folder}/c").awaitTermination()
    found = spark.read.parquet(f"{folder}/o")
    assert found.count() == 600 and found.distinct().count() == 600


def test_window_counts(spark, landing, folder):
    counts = jobs.window_counts(
        stream(spark, landing).withColumn("at", F.col("__ts").cast("timestamp")), "at", "5 seconds", "1 minute", [F.col(OP)]
    )
    flat = counts.select(F.col("window.start").alias("start"), OP, "events")
    jobs.write_stream(flat, f"{folder}/o", f"{folder}/c").awaitTermination()
    want = (
        spark.read.parquet(landing)
        .groupBy(F.date_trunc("minute", "__ts").cast("timestamp").alias("start"), OP)
        .agg(F.count(F.lit(1)).alias("events"))
        .where("start < timestamp '2024-01-01 00:09:00'")
    )
    assert rows(spark.read.parquet(f"{folder}/o")) == rows(want)


def test_lines_of_one_file_are_spread(spark, folder):
    """A log of one file and row group is decoded in many tasks of like size; without spreading, in one."""
    log = spark.range(2000).select(F.hex("id").alias("lsn"), F.concat(F.lit("table public.u: INSERT: id[integer]:"), "id").alias("data"))
    log.coalesce(1).write.parquet(f"{folder}/l")
    seen = {}

    def drain(spread):
        def handle(batch, _):
            seen[spread] = [r["count"] for r in batch.groupBy(F.spark_partition_id()).count().collect()]
            batch.write.mode("append").parquet(f"{folder}/{spread}")

        source = jobs.read_log(spark, f"{folder}/l", log.schema, spread=spread)
        jobs.each_batch(changelog.change_rows(source, {"id": "int8"}), handle, f"{folder}/c{spread}").awaitTermination()
        return rows(spark.read.parquet(f"{folder}/{spread}").select("id", OP))

    assert drain(True) == drain(False) == rows(log.select(F.conv("lsn", 16, 10).cast("bigint").alias("id"), F.lit("create")))
    assert len(seen[False]) == 1 and len(seen[True]) >= 4 and max(seen[True]) < 2 * min(seen[True])


def plain_streaks(found, idle=None):
    """Runs from the sorted rows of each key: ``(k, ok, length, position, recent sum)``."""
    state = {}
    for k, position, ok, at, value in sorted(found, key=lambda r: r[1]):
        old = state.get(k)
        goes_on = old and old[0] == ok and (idle is None or at - old[3] <= idle)
        state[k] = (ok, old[1] + 1 if goes_on else 1, position, at, ([*old[4], value] if old else [value])[-3:])
    return sorted((k, s[0], s[1], s[2], round(sum(s[4]), 6)) for k, s in state.items())


STREAKS = "k bigint, ok boolean, length bigint, position bigint, recent_sum double, repeated bigint, silent boolean"


@pytest.mark.parametrize("files", [3, 20])
def test_streaks_for_any_cut_and_restart(spark, folder, files):
    """Files of uneven size, each with shuffled rows and some of the rows before it; a new query after every seventh."""
    rng = random.Random(files)
    found = [(rng.choice([None, 1, 1, 1, 2, 3]), i, rng.random() < 0.7, i * 1000, rng.random()) for i in range(400)]
    cuts = sorted(rng.sample(range(1, 400), files - 1))
    path, schema = f"{folder}/land", "k bigint, position bigint, ok boolean, at bigint, value double"
    state = KeyedTable(spark, f"{folder}/s", ["k"], STREAKS)
    repeated = Counter()
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, 400], strict=True)):
        part = found[max(0, a - 5) : b]
        repeated.update(r[0] for r in found[max(0, a - 5) : a])
        rng.shuffle(part)
        spark.createDataFrame(part, schema).where("k IS NOT NULL").coalesce(1).write.mode("append").parquet(path)
        if n % 7 == 0 or n == files - 1:
            source = jobs.read_log(spark, path, spark.read.parquet(path).schema, max_files=2)
            jobs.track_streaks(
                source, ["k"], "position", F.col("ok"), state, f"{folder}/c", value=F.col("value"), recent=3
            ).awaitTermination()
    got = state.current().collect()
    keyed_rows = [r for r in found if r[0] is not None]
    assert sorted((r.k, r.ok, r.length, r.position, round(r.recent_sum, 6)) for r in got) == plain_streaks(keyed_rows)
    assert not any(r.silent for r in got)
    assert {r.k: r.repeated for r in got} == {k: repeated[k] for k in (1, 2, 3)}


def test_batches_read_no_state_table(spark, landing, folder, monkeypatch):
    state = KeyedTable(spark, f"{folder}/s", ["k"], "k bigint, ok boolean, length bigint")
    monkeypatch.setattr(KeyedTable, "as_of", lambda *_: pytest.fail("the state table was read"))
    jobs.track_streaks(stream(spark, landing), ["k"], LSN, F.col("code") != "bad", state, f"{folder}/c", None).awaitTermination()
    monkeypatch.undo()
    log = spark.read.parquet(landing)
    full = streaks(log, ["k"], [LSN], log_chunk(F.col(LSN), 32), F.col("code") != "bad")
    last = merge.latest_per_key(full, ["k"], [LSN])
    ok = F.col("code") != "bad"
    want = last.select("k", ok.alias("ok"), F.when(ok, F.col("consecutive_successes")).otherwise(F.col("consecutive_failures")))
    assert rows(state.current()) == rows(want)


def test_silence_ends_runs(spark, folder):
    """Ten seconds of silence: shown by a later row, or by the timer when others move the watermark on."""
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    parts = [[(1, 1, at(0)), (1, 2, at(5)), (2, 3, at(6))], [(1, 4, at(12)), (2, 5, at(17))], [(3, 6, at(60))], [(1, 7, at(61))]]
    state = KeyedTable(spark, f"{folder}/s", ["k"], "k bigint, length bigint, silent boolean")
    seen = []
    for part in parts:
        spark.createDataFrame(part, "k bigint, position bigint, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{folder}/l")
        source = jobs.read_log(spark, f"{folder}/l", spark.read.parquet(f"{folder}/l").schema)
        jobs.track_streaks(source, ["k"], "position", F.lit(True), state, f"{folder}/c", ts="ts", idle_seconds=10).awaitTermination()
        seen.append({r.k: (r.length, r.silent) for r in state.current().collect()})
    assert seen[0] == {1: (2, False), 2: (1, False)}
    assert seen[1] == {1: (3, False), 2: (1, False)}  # key 2 was silent for eleven seconds
    assert seen[2] == {1: (0, True), 2: (0, True), 3: (1, False)}
    assert seen[3] == {1: (1, False), 2: (0, True), 3: (1, False)}


def test_many_keys_share_a_state(spark, folder):
    """The store and Python see buckets, not keys: 6,000 keys of two columns in two batches, then silence and repeated rows."""
    rng = random.Random(7)
    names = [(f"k{i}", i % 5) for i in range(6000)]
    found = [(*k, i, i, rng.random() < 0.7, rng.random()) for i, k in enumerate(rng.choices(names, k=9000) + names)]
    schema, columns = "k string, j int, position bigint, at bigint, ok boolean, value double", ["k", "j"]
    state = KeyedTable(spark, f"{folder}/s", columns, STREAKS.replace("k bigint", "k string, j int"))

    def drain(part):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{folder}/l")
        source = jobs.read_log(spark, f"{folder}/l", spark.createDataFrame([], schema).schema).withColumn("ts", F.timestamp_seconds("at"))
        query = jobs.track_streaks(
            source, columns, "position", F.col("ok"), state, f"{folder}/c", value=F.col("value"), recent=3, ts="ts", idle_seconds=5000
        )
        query.awaitTermination()
        return query, {(r.k, r.j): r for r in state.current().collect()}

    for part in (found[:8000], found[8000:]):
        query, got = drain(part)
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1024
    last = max(r[3] for r in found)
    want = plain_streaks([((k, j), position, ok, at, value) for k, j, position, at, ok, value in found], idle=5000)
    ends = {(r[0], r[1]): r[3] for r in found}
    assert sorted((k, r.ok, r.length, r.position, round(r.recent_sum, 6)) for k, r in got.items()) == [
        (k, ok, 0 if ends[k] + 5000 <= last else length, position, total) for k, ok, length, position, total in want
    ]
    assert {k for k, r in got.items() if r.silent} == {k for k, end in ends.items() if end + 5000 <= last}
    # One key is one second short of its silence, its row repeated; all others' silences end.
    first, second = names[-1], names[-2]
    _, got = drain([(*first, ends[first], last + 4000, True, 0.0), ("new", 0, last + 1, ends[second] + 5000, True, 0.0)])
    assert got[first].repeated == 1 and got[first].length > 0 and not got[first].silent
    assert all(r.silent and r.length == 0 for k, r in got.items() if k not in (first, ("new", 0)))


# ---- windows, rates and holds ----------------------------------------------------------------


def test_rates_with_open_steps(spark, landing, folder):
    log = spark.read.parquet(landing)
    timed = stream(spark, landing).withColumn("at_ts", F.col("__ts").cast("timestamp"))
    rates = windows.rates(timed, [OP], "at_ts", "5 seconds", (60, 120), 10)
    totals = windows.run_watched(spark, lambda: jobs.write_stream(rates, f"{folder}/o", f"{folder}/c"))
    closed = spark.read.schema(rates.schema).parquet(f"{folder}/o")
    opened = windows.open_rates(log, [OP], "__ts", totals, (60, 120), 10)
    assert totals.rows == 600 and totals.batches >= 6 and opened.count() > 0 and closed.count() > 100
    for w in (60, 120):
        want = metrics.moving_rate(log, [OP], "__ts", w, 10).select(OP, "at", "total", F.col("rate").alias("r"))
        assert rows(closed.unionByName(opened).select(OP, "at", f"total_{w}", f"rate_{w}")) == rows(want)


def test_late_rows_are_counted(spark, landing, folder):
    log = spark.read.parquet(landing)
    again = spark.createDataFrame([(1, None, None, "late", 5, datetime(2024, 1, 1, 0, 0, 5))] * 7, SCHEMA)
    runs = []
    for part in (log, again):
        part.write.mode("append").parquet(f"{folder}/l")
        source = jobs.read_log(spark, f"{folder}/l", log.schema).withColumn("at", F.col("__ts").cast("timestamp"))
        closed = jobs.window_counts(source, "at", "5 seconds", "1 minute", [F.col(OP)]).select(F.col("window.start").alias("s"), OP, "events")
        runs.append(windows.run_watched(spark, lambda closed=closed: jobs.write_stream(closed, f"{folder}/o", f"{folder}/c")))
    everything = spark.read.parquet(f"{folder}/l")
    opened = windows.open_windows(everything, "__ts", runs[-1], "1 minute", [F.col(OP)])
    total = windows.Totals(rows=sum(r.rows for r in runs))
    assert windows.late_rows(total, spark.read.parquet(f"{folder}/o"), opened).first()[0] == 7
    assert runs[0].dropped == 0 and runs[1].dropped > 0


def test_failed_runs_are_told(spark, landing, folder):
    broken = stream(spark, landing).select(F.raise_error(F.lit("broken row")).cast("string").alias("x"))
    with pytest.raises(Exception, match="broken row"):
        windows.run_watched(spark, lambda: jobs.write_stream(broken, f"{folder}/o", f"{folder}/c"))


@pytest.mark.parametrize("files", [2, 9])
def test_conditions_that_hold(spark, folder, files):
    """Points of two keys in any cut into batches; the newest row per key and start is the episode."""
    rng = random.Random(files)
    points = [(k, at, rng.random() < 0.75) for at in range(0, 600, 10) for k in ("a", "b") if rng.random() < 0.9]
    schema = "k string, at bigint, hot boolean"
    table = KeyedTable(spark, f"{folder}/e", ["k", "since"], "k string, since bigint, until bigint, samples bigint")
    for n in range(files):
        part = [p for p in points if n * 600 // files <= p[1] < (n + 1) * 600 // files]
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{folder}/l")
        found = windows.held(jobs.read_log(spark, f"{folder}/l", spark.createDataFrame([], schema).schema), ["k"], F.col("hot"), 40)
        jobs.each_batch(found, lambda batch, number: table.upsert(batch, number + 1), f"{folder}/c").awaitTermination()
    want = alerts.episodes(spark.createDataFrame(points, schema), ["k"], "at", F.col("hot"), 40)
    assert rows(table.current()) == rows(want) and want.count() > 2


@pytest.mark.parametrize("number", [1, 4, 9])
def test_copy_beside_a_running_log(spark, landing, folder, number):
    """Ranges are read at moments between the batches of a stream, some changes after the position they are stored at."""
    rng = random.Random(number)
    log = spark.read.parquet(landing).where("code <> 'bad'").withColumn("code", F.col("code").cast("double"))
    base = spark.createDataFrame([(k, "base", float(k)) for k in range(30)], ROW)
    target = KeyedTable(spark, f"{folder}/t", ["k"], ROW)
    task = replace(TASK, transform=Transforms())
    ranges = jobs.key_ranges(base, "k", number)
    assert len(ranges) == number and sum(base.where(r).count() for r in ranges) == 30
    copied = 0
    for batch in range(6):
        part = log.where(F.col(LSN).between(batch * 100, batch * 100 + 99))
        part.write.mode("append").parquet(f"{folder}/l")
        source = jobs.read_log(spark, f"{folder}/l", log.schema)
        jobs.apply_changes(source, task, target, f"{folder}/c", compact_every=None).awaitTermination()
        more = number if batch == 5 else min(number, copied + rng.randrange(3))
        low = batch * 100 + 99
        seen = merge.fan_in(base, log.where(F.col(LSN) <= low + rng.randrange(90)).drop("__ts"), ["k"], [LSN])
        # The last range of a round is copied twice: it replaces itself.
        for start in (copied, max(copied, more - 1)):
            jobs.copy_beside(seen.where, ranges[:more], task, target, lambda low=low: low, start=start)
        copied = more
    assert rows(target.current()) == rows(merge.fan_in(base, log.drop("__ts"), ["k"], [LSN]))
    target.compact()
    assert rows(target.current()) == rows(merge.fan_in(base, log.drop("__ts"), ["k"], [LSN]))


def test_ranges_of_keys(spark):
    keys = spark.createDataFrame([(None, 1)] + [(7, i) for i in range(50)] + [(i, 0) for i in range(20)], "k bigint, x bigint")
    for number in (1, 2, 10):
        ranges = jobs.key_ranges(keys, "k", number)
        assert sum(keys.where(r).count() for r in ranges) == 71
    assert len(jobs.key_ranges(keys.limit(0), "k", 5)) == 1


def test_batches_of_rows(spark, landing, folder):
    """Two files of 100 rows per micro-batch, cut after 70 rows; a micro-batch that runs again replaces its batches."""
    source = jobs.read_log(spark, landing, spark.read.parquet(landing).schema, max_files=2)
    for checkpoint in ("c", "again"):
        jobs.row_batches(source, LSN, f"{folder}/o", f"{folder}/{checkpoint}", 70, 16).awaitTermination()
        found = jobs.batch_list(spark, f"{folder}/o", LSN).orderBy("batch_number").collect()
        assert [(r.batch_number, r.rows) for r in found] == list(enumerate([70, 70, 60] * 3))
        assert [r.first_position for r in found][:4] == [0, 70, 140, 200] and found[-1].last_position == 599


def test_latest_state(spark, landing, folder):
    latest = jobs.latest_state(stream(spark, landing), ["k"], LSN, ["v", OP])
    table = KeyedTable(spark, f"{folder}/s", ["k"], "k bigint, v string, changes bigint")
    flat = latest.select("k", "doc.v", "changes")
    jobs.each_batch(flat, lambda b, n: table.upsert(b, n + 1), f"{folder}/c", mode="update").awaitTermination()
    log = spark.read.parquet(landing)
    want = log.groupBy("k").agg(F.max_by("v", LSN).alias("v"), F.count(F.lit(1)).alias("changes"))
    assert rows(table.current()) == rows(want)


def test_compacted(spark, landing):
    log = spark.read.parquet(landing)
    assert jobs.compacted(log, ["k"]).where(f"{OP} = 'delete'").count() == 0
