import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from driftline.llm import mixing, packing


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def fill(sizes, weights, share, cap):
    """Water-filling as it is told: clamp, share out again, until no target is above its cap."""
    target, free, left = {}, dict(weights), share * sum(sizes.values())
    while free:
        over = [s for s in free if cap * sizes[s] <= left * free[s] / sum(free.values())]
        if not over:
            return target | {s: left * w / sum(free.values()) for s, w in free.items()}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            del free[s]
    return target


def test_water_fill(spark):
    rng = np.random.default_rng(1)
    for share in (0.5, 1.5, 1.9, 2.0, 3.0):
        sizes = {f"s{i:02}": int(x) for i, x in enumerate(rng.integers(0, 1000, 12) ** 2)}
        weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sizes)}
        df = spark.createDataFrame([(s, n, float(weights[s])) for s, n in sizes.items()], "s string, size bigint, weight double")
        got = {r["s"]: r["target"] for r in mixing.water_fill(df, share, 2.0).collect()}
        want = fill(sizes, weights, share, 2.0)
        assert got == pytest.approx(want)


def test_ranked_over_many_partitions(spark):
    names = [chr(300 + 7 * i) * (1 + i % 3) for i in range(97)] + ["Z", "a", "", "\U0001f600", "￿", None]
    df = spark.createDataFrame([(n,) for n in names], "s string").repartition(5)
    got = {r["s"]: r["rank"] for r in mixing.ranked(df, "s").collect()}
    want = sorted((n for n in names if n is not None)) + [None]
    assert [got[n] for n in want] == list(range(len(names)))


def check_mix(out, docs):
    size, target, taken = defaultdict(int), {}, defaultdict(int)
    for (key, text, source), r in zip(docs, out, strict=True):
        assert r["size"] == words(text) and 0 <= r["taken"] <= 2 * r["size"]
        size[source] += r["size"]
        taken[source] += r["taken"]
        target[source] = r["target"]
    names = sorted((s for s in size if s is not None)) + [s for s in size if s is None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    assert target == pytest.approx(fill(size, weights, 1.5, 2.0))
    for s in size:
        assert abs(taken[s] - target[s]) <= 0.5


def test_mix(spark, odd_docs, rows):
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["source_size"])
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += words(r[1])
    docs = sorted([(r[0], r[1], r[3]) for r in rows], key=lambda d: (d[0] is not None, d[0] or 0, words(d[1]), size[d[2]]))
    out = sorted(mixing.mix(odd_docs).collect(), key=key)
    check_mix(out, docs)
    again = sorted(mixing.mix(odd_docs.repartition(7)).collect(), key=key)
    assert [tuple(r) for r in out] == [tuple(r) for r in again]


def test_mixed_rows(odd_docs):
    """Every row whole, as often as it is taken; the row taken in part goes to the nearer side."""
    want = Counter()
    for r in mixing.mix(odd_docs).where("taken > 0").collect():
        want[r["doc_id"]] += (2 * r["taken"] + r["size"]) // (2 * r["size"])
    out = mixing.mixed(odd_docs)
    assert out.columns == odd_docs.columns and dict(out.dtypes) == dict(odd_docs.dtypes)
    rows = out.collect()
    assert {tuple(r) for r in rows} <= {tuple(r) for r in odd_docs.collect()}
    assert Counter(r["doc_id"] for r in rows) == +want


def test_sources_of_the_mix_come_near_their_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sizes = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    taken, target, widest = defaultdict(int), {}, defaultdict(int)
    for r in docs.collect():
        s = sizes[r["doc_id"]]
        target[r["source"]], widest[r["source"]] = s["target"], max(widest[r["source"]], s["size"])
    for r in mixing.mixed(docs).collect():
        taken[r["source"]] += words(r["text"])
    assert all(abs(taken[s] - target[s]) <= widest[s] / 2 + 0.5 for s in target)


def test_mix_of_nothing(no_docs):
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0


def test_mix_of_blank_texts(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id bigint, text string, source string")
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mix(docs).collect()] == [(0, 0.0, 0)] * 2


# ---- packing ---------------------------------------------------------------------------------


def padding(lengths, counts, cut):
    return sum(c * (min(b for b in cut if b >= x) - x) for x, c in zip(lengths, counts, strict=True))


def test_bounds_are_optimal():
    rng = np.random.default_rng(5)
    for _ in range(60):
        lengths = np.sort(rng.choice(np.arange(1, 60), rng.integers(1, 10), replace=False))
        counts = rng.integers(1, 50, len(lengths))
        for buckets in (1, 2, 3, 5, 20):
            cut = packing.bounds(lengths, counts, buckets)
            assert len(cut) <= buckets and cut[-1] == lengths[-1] and cut == sorted(set(cut))
            every = [
                (*c, lengths[-1]) for k in range(min(buckets, len(lengths))) for c in combinations(lengths[:-1], k)
            ]
            assert padding(lengths, counts, cut) == min(padding(lengths, counts, c) for c in every)
    assert packing.bounds(np.array([]), np.array([]), 4) == []


@pytest.mark.parametrize("max_words,buckets,budget", [(4096, 8, 32768), (3, 2, 4), (1000, 1, 10)])
def test_pack(odd_docs, rows, max_words, buckets, budget):
    out = packing.pack(odd_docs, max_words=max_words, buckets=buckets, budget=budget).collect()
    pieces = defaultdict(int)
    for r in out:
        assert r["first_word"] == r["piece"] * max_words and 1 <= r["n_words"] <= min(max_words, r["bucket"])
        pieces[r["doc_id"]] += r["n_words"]
    want = defaultdict(int)
    for r in rows:
        want[r[0]] += words(r[1])
    assert dict(pieces) == {k: v for k, v in want.items() if v}
    cut = sorted({r["bucket"] for r in out})
    assert len(cut) <= buckets
    lengths, counts = np.unique([r["n_words"] for r in out], return_counts=True)
    assert cut == packing.bounds(lengths, counts, buckets)
    batches = defaultdict(list)
    for r in out:
        assert r["bucket"] == min(b for b in cut if b >= r["n_words"])
        batches[r["bucket"], r["batch"]].append(r["slot"])
    for (bucket, batch), slots in batches.items():
        room = max(1, budget // bucket)
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= room
        assert len(slots) == room or (bucket, batch + 1) not in batches


def test_pack_of_nothing(spark, no_docs):
    assert packing.pack(no_docs).count() == 0
    assert packing.pack(spark.createDataFrame([(1, None), (2, " ")], "doc_id bigint, text string")).count() == 0
