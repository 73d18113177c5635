"""Merging into buckets: only what a batch touches is read and written, and nothing of the table is shuffled."""

import glob
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from driftline.operators import LSN, OP, UNCHANGED, merge
from driftline.sources.bucketed_table import PART, BucketedTable

ROW = "k bigint, v string, w double"
CHANGE = f"{ROW}, {OP} string, {LSN} bigint"


@pytest.fixture
def table(spark, folder):
    made = BucketedTable(spark, f"t_{uuid.uuid4().hex}", ["k"], ROW, f"{folder}/t", parts=8, buckets=4)
    made.write_base(spark.range(100).select(F.col("id").alias("k"), F.lit("base").alias("v"), F.col("id").cast("double").alias("w")))
    yield made
    spark.sql(f"DROP TABLE IF EXISTS {made.name}")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(folder):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/t/{PART}=*/*.parquet")}


def change(k, op, lsn, v=None, w=None):
    return (k, v, w, op, lsn)


def test_twenty_batches(spark, table):
    rng = random.Random(1)
    log = [change(rng.randrange(130), rng.choice(["create", "update", "delete"]), i + 1, f"v{i}", float(i)) for i in range(600)]
    base = spark.createDataFrame(table.current().collect(), ROW)
    for i in range(20):
        part = log[i * 30 : (i + 1) * 30]
        rng.shuffle(part)
        table.merge(spark.createDataFrame(part, CHANGE))
        if i in (7, 19):
            seen = spark.createDataFrame(log[: (i + 1) * 30], CHANGE)
            assert rows(table.current()) == rows(merge.fan_in(base, seen, ["k"], [LSN]).select("k", "v", "w"))
    before = rows(table.current())
    table.merge(spark.createDataFrame(log[-90:], CHANGE))
    assert rows(table.current()) == before


def test_untouched_partitions_stay(spark, table, folder):
    before = files(folder)
    written = table.merge(spark.createDataFrame([change(5, "update", 1, "new"), change(1000, "create", 2, "x")], CHANGE))
    after = files(folder)
    assert 1 <= len(written) <= 2
    of = lambda p: {f for f in [*before, *after] if f"/{PART}={p}/" in f}
    for p in range(8):
        same = {f: before.get(f) for f in of(p)} == {f: after.get(f) for f in of(p)}
        assert same == (p not in written)
    assert {r["v"] for r in table.current().where("k IN (5, 1000)").collect()} == {"new", "x"} and table.current().count() == 101


@pytest.mark.parametrize("partitions", [3, 4, 50])
def test_plan_shuffles_the_batch_only(spark, table, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        latest = merge.latest_per_key(spark.createDataFrame([change(5, "update", 1, "new")], CHANGE), ["k"], [LSN])
        plan = table.merged(latest, table.touched(latest))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    side = plan[plan.index("FullOuter") :]
    scan = side[: side.index("FileScan")]
    assert "Exchange" not in scan and "Bucketed: true" in side and f"{PART}#" in side[side.index("PartitionFilters") :][:60]


def test_partition_without_rows_is_emptied(spark, table):
    part = spark.table(table.name).where(F.col(PART) == 3).select("k").collect()
    assert table.merge(spark.createDataFrame([change(r["k"], "delete", 9) for r in part], CHANGE)) == [3]
    assert spark.table(table.name).where(F.col(PART) == 3).count() == 0 and table.current().count() == 100 - len(part)
    table.merge(spark.createDataFrame([change(part[0]["k"], "create", 10, "back")], CHANGE))
    assert table.current().count() == 101 - len(part)


def test_older_changes_change_nothing(spark, table):
    table.merge(spark.createDataFrame([change(1, "update", 50, "fifty")], CHANGE))
    table.merge(spark.createDataFrame([change(1, "update", 40, "forty"), change(2, "delete", 41)], CHANGE))
    assert rows(table.current().where("k <= 2").select("k", "v")) == [(0, "base"), (1, "fifty")]
    assert table.merge(spark.createDataFrame([], CHANGE)) == []


def test_keyless_rows_end_the_merge(spark, table):
    with pytest.raises(Exception, match="change without a key"):
        table.merge(spark.createDataFrame([change(None, "create", 1, "x")], CHANGE))
    assert table.current().count() == 100


def test_unchanged_fields_and_a_table_from_nothing(spark, folder):
    table = BucketedTable(spark, f"t_{uuid.uuid4().hex}", ["k"], ROW, f"{folder}/t", parts=4, buckets=2, unchanged=True)
    table.merge(spark.createDataFrame([change(1, "create", 1, "a", 1.0), change(2, "create", 2, "b", 2.0)], CHANGE))
    later = [(1, None, 5.0, "update", 3, ["v"]), (2, "c", None, "update", 4, [])]
    table.merge(spark.createDataFrame(later, f"{CHANGE}, {UNCHANGED} array<string>"))
    assert rows(table.current()) == [(1, "a", 5.0), (2, "c", None)]
    spark.sql(f"DROP TABLE {table.name}")
