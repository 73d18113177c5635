"""Order-dependent operators against plain Python, with one hot key and many small chunks."""

import random

import pytest
from pyspark.sql import functions as F

from driftline.operators import asof, metrics, ordered, topk


def make_rows(seed, n=300):
    """A third of the rows belongs to key ``hot``; one key is null; positions have gaps."""
    rng = random.Random(seed)
    rows, position = [], 0
    for i in range(n):
        position += rng.choice([1, 1, 2, 40])
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", None])
        rows.append((key, position, rng.choice([True, False, True, None]), float(rng.randrange(100)), rng.random() < 0.2))
    return rows


SCHEMA = "k string, pos bigint, ok boolean, v double, mark boolean"


@pytest.fixture(scope="module", params=[1, 2])
def case(spark, request):
    rows = make_rows(request.param)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module", autouse=True, params=["10m", "-1"])
def joins(spark, request):
    """Both ways the summaries can meet their rows: broadcast, and shuffled and sorted."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def by_key(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(r[0], []).append(r)
    return groups


def chunk(size=16):
    return ordered.log_chunk(F.col("pos"), size)


def test_running_values(case):
    rows, df = case
    marked = F.when(F.col("mark"), F.col("v"))
    specs = {
        "total": ("sum", F.col("v")),
        "top": ("max", F.col("v")),
        "prev": ("prev", F.when(F.col("ok"), F.col("v"))),
        "last": ("last", marked),
    }
    got = {(r.k, r.pos): r for r in ordered.running(df, ["k"], ["pos"], chunk(), specs).collect()}
    assert len(got) == len(rows)
    for key, group in by_key(rows).items():
        total, top, last, before = 0.0, None, None, None
        for r in group:
            total += r[3]
            top = r[3] if top is None else max(top, r[3])
            last = r[3] if r[4] else last
            found = got[(key, r[1])]
            assert (found.total, found.top, found.last, found.prev) == (total, top, last, before)
            before = r[3] if r[2] else None


def test_numbers_and_batches(case):
    rows, df = case
    numbered = {(r.k, r.pos): r.rn for r in ordered.numbered(df, ["k"], ["pos"], chunk()).collect()}
    cut = {(r.k, r.pos): r.batch_id for r in ordered.batch_numbers(df, ["k"], ["pos"], chunk(), 7).collect()}
    for key, group in by_key(rows).items():
        for i, r in enumerate(group):
            assert numbered[(key, r[1])] == i + 1 and cut[(key, r[1])] == i // 7


def test_streaks(case):
    rows, df = case
    got = {(r.k, r.pos): r for r in ordered.streaks(df, ["k"], ["pos"], chunk(), F.col("ok")).collect()}
    for key, group in by_key(rows).items():
        good = bad = 0
        for r in group:
            good, bad = (good + 1, 0) if r[2] else (0, bad + 1)
            found = got[(key, r[1])]
            assert (found.consecutive_successes, found.consecutive_failures) == (good, bad)


@pytest.mark.parametrize("size", [2, 16, 1000])
def test_moving_mean(case, size):
    rows, df = case
    got = ordered.moving_mean(df, ["k"], ["pos"], chunk(size), {"v": F.col("v")}, width=10).collect()
    got = {(r.k, r.pos): r for r in got}
    for key, group in by_key(rows).items():
        for i, r in enumerate(group):
            window = [x[3] for x in group[max(0, i - 9) : i + 1]]
            found = got[(key, r[1])]
            assert (found.v_sum, found.window_rows) == (sum(window), len(window))


def test_order_violations(spark):
    rows = [("a", i, p) for i, p in enumerate([1, 2, 2, 9, 4, 5, 10, 10])] + [("b", 0, 5), ("b", 40, 4)]
    df = spark.createDataFrame(rows, "k string, n bigint, lsn bigint")
    got = ordered.order_violations(df, ["k"], ["n"], ordered.log_chunk(F.col("n"), 3), "lsn")
    assert sorted((r.k, r.n, r.previous) for r in got.collect()) == [("a", 2, 2), ("a", 4, 9), ("a", 7, 10), ("b", 40, 5)]


@pytest.mark.parametrize("index_rows", [0, 100_000])
def test_asof_join(case, spark, index_rows):
    """The broadcast index and the carried log find the same versions."""
    rows, df = case
    changes = df.where("NOT mark").select("k", "pos")
    versions = df.where("mark").select("k", "pos", F.col("v").alias("version"))
    place = next(r[1] for r in rows if r[0] == "hot" and not r[4])
    at_same_place = spark.createDataFrame([("hot", place, -1.0)], "k string, pos bigint, version double")
    got = asof.asof_join(changes, versions.union(at_same_place), "k", "pos", ["version"], segment=16, index_rows=index_rows).collect()
    got = {(r.k, r.pos): r.version for r in got}
    for key, group in by_key(rows).items():
        last = None
        for r in group:
            if key == "hot" and r[1] == place:
                last = -1.0
            if r[4]:
                last = r[3]
            else:
                assert got[(key, r[1])] == last
    assert len(got) == sum(not r[4] for r in rows)


def test_keep_newest(spark):
    rng = random.Random(3)
    rows = [(i, f"2024-01-01 00:{rng.randrange(4):02d}:{rng.randrange(60):02d}") for i in range(400)]
    df = spark.createDataFrame(rows, "id int, s string").select("id", F.col("s").cast("timestamp_ntz").alias("at"))
    for n in (0, 1, 57, 399, 400, 1000):
        want = sorted(i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)[:n])
        assert sorted(r.id for r in topk.keep_newest(df, n, "at", "id").collect()) == want


def test_many_rows_per_key(spark):
    """More rows than are cut early, with many rows of one time in a hot key."""
    rng = random.Random(4)
    rows = [("hot" if i % 3 else rng.choice("abc"), i, rng.choice([5, 5, 5, 6, 7, 100, 200])) for i in range(9000)]
    df = spark.createDataFrame(rows, "k string, id int, s int").select(
        "k", "id", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("s"))).alias("at"), "s"
    )
    for newest, cut in ((True, topk.newest_per_key), (False, topk.oldest_per_key)):
        for n in (1001, 2500, 5999):
            got = {}
            for r in cut(df, ["k"], n, "at", "id").collect():
                got.setdefault(r.k, []).append((r.s, r.id))
            for key in ("hot", "a", "b", "c"):
                times = sorted((s for k, _, s in rows if k == key), reverse=newest)[:n]
                assert sorted((s for s, _ in got[key]), reverse=newest) == times
                assert len(set(got[key])) == len(got[key])


@pytest.mark.parametrize("ranked", [10, 10**6])
def test_cuts_by_range_and_by_window_agree(spark, monkeypatch, ranked):
    """Ties of time, missing times and rows that are equal in all: sorted in many tasks or ranked in one."""
    monkeypatch.setattr(topk, "RANKED_ROWS", ranked)
    rng = random.Random(5)
    rows = [(rng.choice("ab"), i // 2 if i < 600 else i, rng.choice([None, 5, 5, 5, 6, 60])) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, id int, s int").select(
        "k", "id", F.when(F.col("s").isNotNull(), F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("s"))).alias("at"), "s"
    )
    order = lambda r: (r[2] is not None, r[2] or 0, r[1])
    for newest in (True, False):
        for keys in ([], ["k"]):
            for n in (333, 5000):
                got = sorted((tuple(r) for r in topk.cut_by_time(df, keys, n, "at", "id", newest).select("k", "id", "s").collect()), key=str)
                want = []
                for key in ("a", "b") if keys else (None,):
                    own = sorted((r for r in rows if key in (None, r[0])), key=order, reverse=newest)
                    want += own[:n]
                if keys:  # rows equal in time and id have the same key
                    assert got == sorted(want, key=str)
                assert sorted(map(order, got)) == sorted(map(order, want))


def test_histogram_quantile(spark):
    bounds = (1.0, 2.0, 4.0)
    rows = spark.createDataFrame([("a", v) for v in (0.5, 0.5, 1.5, 3.0, 3.5, 9.0)] + [("b", 9.0), ("c", None)], "k string, v double")
    got = {r.k: r for r in metrics.quantiles(rows, ["k"], F.col("v"), bounds, {"p50": 0.5, "p99": 0.99}).collect()}
    assert (got["a"].p50, got["a"].p99) == (2.0, 4.0)
    assert (got["b"].p50, got["c"].p50) == (4.0, None)
    hist = metrics.histogram_rows(metrics.histogram(rows, ["k"], F.col("v"), bounds), ["k"], bounds)
    assert [r.cumulative for r in hist.where("k = 'a'").collect()] == [2, 3, 5, 6]
