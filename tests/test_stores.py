"""Merging, keyed tables, dead letters and progress."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from driftline.operators import LSN, deadletters, dedup, merge, progress
from driftline.sources import tables
from driftline.sources.deadletter_table import DeadLetterTable
from driftline.sources.keyed_table import KeyedTable

CHANGES = "k int, v string, __op string, __lsn bigint"


def pairs(df):
    return sorted((r.k, r.v) for r in df.select("k", "v").collect())


@pytest.fixture
def base(spark):
    return spark.createDataFrame([(1, "1"), (2, "2"), (3, "3")], "k int, v string")


def test_merge(spark, base):
    log = spark.createDataFrame(
        [(2, "old", "update", 1), (2, "2'", "update", 4), (4, "4", "create", 2), (3, None, "delete", 3)], CHANGES
    )
    assert pairs(merge.fan_in(base, log, ["k"], [LSN])) == [(1, "1"), (2, "2'"), (4, "4")]


def test_delete_then_create_again(spark, base):
    log = spark.createDataFrame([(1, None, "delete", 5), (1, "new", "create", 6), (2, "x", "truncate", 7)], CHANGES)
    assert pairs(merge.fan_in(base, log, ["k"], [LSN])) == [(1, "new"), (2, "2"), (3, "3")]


def test_replay_and_partitioning_do_not_matter(spark, base):
    rows = [(i % 7, f"v{i}", ["create", "update", "delete"][i % 3], i) for i in range(60)]
    log = spark.createDataFrame(rows, CHANGES)
    want = pairs(merge.fan_in(base, log, ["k"], [LSN]))
    assert pairs(merge.fan_in(base, log.union(log).repartition(9), ["k"], [LSN])) == want
    assert pairs(merge.fan_in(base, log.repartition(1).orderBy(F.desc(LSN)), ["k"], [LSN])) == want


def test_unchanged_columns(spark):
    base = spark.createDataFrame([(1, "a0", "b0"), (2, "c0", "d0")], "k int, a string, b string")
    log = spark.createDataFrame(
        [
            (1, "a1", None, "update", 1, ["b"]),
            (1, None, "b2", "update", 2, ["a"]),
            (2, None, None, "update", 3, ["a"]),
            (3, "n", "m", "create", 4, []),
            (3, None, "m2", "update", 5, ["a"]),
        ],
        "k int, a string, b string, __op string, __lsn bigint, __unchanged array<string>",
    )
    latest = merge.fill_unchanged(merge.fold_unchanged(log, ["k"], LSN, ["a", "b"]), base, ["k"])
    got = merge.merge_snapshot(base, latest, ["k"])
    assert sorted(map(tuple, got.collect())) == [(1, "a1", "b2"), (2, "c0", None), (3, "n", "m2")]


def test_document_actions(spark):
    log = spark.createDataFrame(
        [(1, "a", "create"), (2, None, "delete"), (3, "c", "delete"), (4, "d", "schema")], "n int, id string, __op string"
    )
    act = lambda df, key: [(r.action, r.doc_id) for r in merge.document_actions(df, key).orderBy("n").collect()]
    assert act(log, "id") == [("upsert", "a"), ("skip", None), ("delete", "c"), ("skip", "d")]
    assert [a for a, _ in act(log, "nowhere")] == ["upsert", "error", "error", "skip"]
    assert [a for a, _ in act(log, None)] == ["upsert", "error", "error", "skip"]
    assert act(log.withColumn("f", F.lit(1.5)), "f")[2] == ("skip", None)


def test_dedup_statistics(spark):
    keys = "lsn string, xid bigint, table_name string, pk string"
    same = spark.createDataFrame([("0/1", None, "t", "1")] * 5, keys)
    row = lambda df, window: dedup.dedup_stats(df, dedup.DELIVERY_KEY, window).first()
    assert tuple(row(same, 10)) == (5, 4, 0, 0.8)
    many = spark.createDataFrame([(f"0/{i}", None, "t", None) for i in range(6)], keys)
    assert tuple(row(many, 5)) == (6, 0, 1, 0.0)
    assert tuple(row(many.limit(0), 5)) == (0, 0, 0, 0.0)


# --- keyed tables ---------------------------------------------------------------------------


def test_versions(spark, base, folder):
    table = KeyedTable(spark, f"{folder}/t", ["k"], base.schema)
    assert table.version() == -1 and table.current().count() == 0
    table.write_base(base)
    log = spark.createDataFrame([(2, "2'", "update", 10), (3, None, "delete", 11)], CHANGES)
    table.write_batch(log, 1)
    assert pairs(table.current()) == [(1, "1"), (2, "2'")]
    table.write_batch(log, 1)
    before = table.current()
    assert pairs(before) == [(1, "1"), (2, "2'")]
    table.write_batch(spark.createDataFrame([(3, "again", "create", 20)], CHANGES), 2)
    assert pairs(table.as_of(1)) == [(1, "1"), (2, "2'")]
    assert table.compact() == 2 and table.compact() == 2
    assert pairs(table.current()) == [(1, "1"), (2, "2'"), (3, "again")]
    assert table.changes().count() == 0 and pairs(before) == [(1, "1"), (2, "2'")]


def test_unfinished_writes_are_not_read(spark, base, folder):
    table = KeyedTable(spark, f"{folder}/t", ["k"], base.schema)
    table.write_base(base)
    table.write_batch(spark.createDataFrame([(9, "9", "create", 1)], CHANGES), 1)
    table.write_base(table.current(), 5)
    os.remove(f"{folder}/t/changes/batch=1/_SUCCESS")
    os.remove(f"{folder}/t/base/v=5/_SUCCESS")
    assert table.version() == 0 and pairs(table.current()) == pairs(base)


def test_left_out_fields_across_batches(spark, folder):
    base = spark.createDataFrame([(1, "a0", "b0"), (2, "c0", "d0")], "k int, a string, b string")
    table = KeyedTable(spark, f"{folder}/t", ["k"], base.schema, unchanged=True)
    table.write_base(base)
    schema = "k int, a string, b string, __op string, __lsn bigint, __unchanged array<string>"
    table.write_batch(spark.createDataFrame([(1, None, "b1", "update", 1, ["a"]), (3, "e", "f", "create", 2, [])], schema), 1)
    table.write_batch(spark.createDataFrame([(1, "a2", None, "update", 3, ["b"]), (3, None, "g", "update", 4, ["a"])], schema), 2)
    want = [(1, "a2", "b1"), (2, "c0", "d0"), (3, "e", "g")]
    assert sorted(map(tuple, table.current().collect())) == want
    table.compact()
    assert sorted(map(tuple, table.current().collect())) == want


def test_publish(spark, base, folder):
    table = KeyedTable(spark, f"{folder}/t", ["k"], base.schema)
    table.write_base(base)
    table.publish("published")
    table.write_batch(spark.createDataFrame([(1, None, "delete", 1)], CHANGES), 1)
    assert spark.table("published").count() == 3
    table.publish("published")
    assert spark.table("published").count() == 2


def test_import_counts(spark, base, folder):
    assert tables.import_documents(base, f"{folder}/i") == {"imported": 3}
    assert tables.scan_table(spark, f"{folder}/i").count() == 3


# --- dead letters ---------------------------------------------------------------------------


def letters(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [
        ("1", "t1", "{}", "Network\nx", 0, at(1), None),
        ("2", "t1", "{}", "Network", 0, at(2), None),
        ("3", "t1", "{}", "Parse", 0, at(3), None),
        ("4", "t2", "{}", "Schema", 0, at(4), None),
        ("5", "t2", "{}", "Schema", 0, at(5), None),
        ("6", "t2", "{}", "Schema", 0, at(6), None),
    ]
    return spark.createDataFrame(rows, deadletters.ENTRY_SCHEMA)


def test_dead_letter_statistics(spark):
    got = {(r.scope, r.name): r.entries for r in deadletters.statistics(letters(spark)).collect()}
    assert got == {
        ("total", ""): 6, ("task", "t1"): 3, ("task", "t2"): 3,
        ("error", "Network"): 2, ("error", "Parse"): 1, ("error", "Schema"): 3,
    }
    assert [r.task_id for r in deadletters.task_list(letters(spark)).collect()] == ["t1", "t2"]


def test_dead_letter_table(spark, folder):
    store = DeadLetterTable(spark, f"{folder}/d")
    store.store(letters(spark))
    store.store(letters(spark))
    assert store.read().count() == 6 and store.get("4").first().error == "Schema"
    taken = store.take_for_retry("t1", 2, F.lit("2024-02-01 00:00:00"))
    assert sorted((r.id, r.retry_count, str(r.last_retry_at)) for r in taken.collect()) == [
        ("1", 1, "2024-02-01 00:00:00"),
        ("2", 1, "2024-02-01 00:00:00"),
    ]
    assert sorted(r.id for r in store.read().collect()) == ["3", "4", "5", "6"]
    assert store.clear_task("t2") == 3 and store.clear_task("t2") == 0
    store.store(taken)
    assert sorted(r.id for r in store.read().collect()) == ["1", "2", "3"]
    now = F.lit("2024-01-01 01:02:30").cast("timestamp_ntz")
    store.retain(10, now, hours=1)
    assert sorted(r.id for r in store.read().collect()) == ["3"]


def test_triage(spark):
    cases = [
        ("network", 0, 1, 0, "retry"), ("network", 3, 1, 31, "pause"), ("timeout", 3, 1, 30, "dead_letter"),
        ("permission", 0, 1, 0, "pause"), ("data_validation", 0, 1, 0, "dead_letter"), ("not_found", 1, 1, 0, "retry"),
        ("not_found", 2, 1, 0, "skip"), ("rate_limit", 99, 1, 0, "retry"), ("unknown", 2, 1, 0, "retry"),
        ("unknown", 3, 1, 99, "dead_letter"), ("rate_limit", 0, 10, 0, "pause"),
    ]
    df = spark.createDataFrame(cases, "kind string, retries int, streak int, minutes int, want string")
    first = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    action = deadletters.triage_action(
        F.col("kind"), F.col("retries"), F.col("streak"), first, first + F.make_dt_interval(mins=F.col("minutes"))
    )
    assert [(r.kind, r.a) for r in df.select("kind", "want", action.alias("a")).collect() if r.a != r.want] == []


# --- progress -------------------------------------------------------------------------------


def test_progress(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [("a", "t1", 5, at(1)), ("b", "t1", 9, at(2)), ("c", "t2", 3, at(1)), ("d", "t3", 7, at(9))]
    log = spark.createDataFrame(rows, "id string, task_id string, position bigint, created_at timestamp_ntz")
    assert sorted(r.id for r in progress.latest(log).collect()) == ["b", "c", "d"]
    assert sorted(r.id for r in progress.keep_recent(log, 1).collect()) == ["b", "c", "d"]
    pending = spark.createDataFrame([("p", "t2", 4, at(0))], log.schema)
    assert sorted(r.id for r in progress.overlay(pending, progress.latest(log)).collect()) == ["b", "d", "p"]
    tasks = spark.createDataFrame([("s1", "t1"), ("s1", "t2"), ("s2", "t9")], "source_name string, task_id string")
    assert sorted(r.id for r in progress.orphans(log, tasks).collect()) == ["d"]
    points = progress.resume_points(tasks, progress.latest(log)).orderBy("source_name").collect()
    assert [tuple(r) for r in points] == [("s1", 2, 2, 3, "t2"), ("s2", 1, 0, None, None)]


def test_task_status(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [("t1", "running", None, 0, at(0))] + [("t1", None, f"e{i}", i, at(i)) for i in range(1, 12)]
    rows += [("t2", "running", None, 0, at(0)), ("t2", "paused", "e", 1, at(1)), ("t3", None, "e", 1, at(1))]
    log = spark.createDataFrame(rows, "task_id string, state string, error string, n int, at timestamp_ntz")
    status = progress.task_status(log, ["n"], "at")
    assert {r.task_id: (r.state, r.error_count, r.last_error) for r in status.collect()} == {
        "t1": ("failed", 11, "e11"), "t2": ("paused", 1, "e"), "t3": ("idle", 1, "e"),
    }
    assert tuple(progress.status_summary(status).first()) == (3, 0, 1)
    now = F.lit("2024-01-01 00:16:00").cast("timestamp_ntz")
    assert progress.stale_failures(status, now).count() == 0
    assert progress.stale_failures(status, now + F.expr("INTERVAL 61 SECOND")).first().minutes_failed == 6


def test_writers_share_a_table(spark, base, folder):
    table = KeyedTable(spark, f"{folder}/t", ["k"], base.schema)
    table.write_base(base)
    one = lambda k, v, lsn: spark.createDataFrame([(k, v, "update", lsn)], CHANGES)
    table.write_batch(one(1, "s1", 10), 1, "stream")
    table.write_batch(one(2, "e1", 11), 1, "edits")
    table.write_batch(one(1, "s1", 10), 1, "stream")  # run again: the same place
    assert table.place_of(1, "stream") == 1 and table.place_of(1, "edits") == 2 and table.place_of(2, "stream") == 3
    assert table.compact() == 2
    table.write_batch(one(3, "s2", 12), 1, "other")  # a stream that starts over
    assert pairs(table.current()) == [(1, "s1"), (2, "e1"), (3, "s2")]
    assert table.compact() == 3 and table.changes().count() == 0
    assert pairs(table.current()) == [(1, "s1"), (2, "e1"), (3, "s2")]


def test_late_batch_below_the_base_is_not_lost(spark, base, folder):
    table = KeyedTable(spark, f"{folder}/t", ["k"], base.schema)
    table.write_base(base)
    slow = spark.createDataFrame([(7, "slow", "create", 1)], CHANGES)
    table.write_batch(spark.createDataFrame([(8, "fast", "create", 2)], CHANGES), 2)
    table.compact()
    table.write_batch(slow, 1)  # place 1, finished after the base at place 2
    assert (7, "slow") in pairs(table.current()) and table.compact() == 3
    assert (7, "slow") in pairs(table.current())


def test_keyless_changes_are_refused(spark, base, folder):
    table = KeyedTable(spark, f"{folder}/t", ["k"], base.schema)
    with pytest.raises(Exception, match="change without a key"):
        table.write_batch(spark.createDataFrame([(None, "x", "update", 1)], CHANGES), 1)


def test_failed_send_leaves_the_entries(spark, folder):
    store = DeadLetterTable(spark, f"{folder}/d")
    store.store(letters(spark))

    def broken(rows):
        raise OSError("down")

    with pytest.raises(OSError):
        store.take_for_retry("t1", 2, F.lit("2024-02-01 00:00:00"), broken)
    assert store.read().count() == 6
    store.take_for_retry("t1", 2, F.lit("2024-02-01 00:00:00"), lambda rows: rows.where("id = '2'"))
    assert sorted((r.id, r.retry_count) for r in store.read().where("task_id = 't1'").collect()) == [("2", 1), ("3", 0)]
