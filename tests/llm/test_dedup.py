import hashlib
import random
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from driftline.llm import common, exact_dedup, simhash


def reachable(nodes, linked):
    """Smallest node reachable from each, by repeated search."""
    seen = {}
    for start in sorted(nodes):
        if start in seen:
            continue
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen[x] = start
                todo += [y for y in nodes if y not in seen and linked(x, y)]
    return seen


# ---- components ------------------------------------------------------------------------------


def test_components_of_chains_stars_and_pairs(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, 100 + i) for i in range(1, 300)]
    edges = chain + star + [(500, 501), (502, 501), (7, 7), (500, 501)]
    got = dict(tuple(r) for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    groups = [set(range(61)), set(range(100, 400)), {500, 501, 502}]
    assert set(got) == set().union(*groups)
    for group in groups:
        assert len({got[n] for n in group}) == 1 and got[min(group)] in group
    assert len({got[0], got[100], got[500]}) == 3


def test_components_of_nothing(spark):
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_running_before(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["x", None]), rng.randrange(5), rng.randrange(1 << 60), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v bigint, o bigint, i bigint")
    got = {r["i"]: r["before"] for r in common.running_before(df, "g", "v", "o", ["i"], "before", shard_bits=4).collect()}
    for g, _, o, i in rows:
        assert got[i] == sum(v for h, v, p, j in rows if h == g and (p, j) < (o, i))


# ---- exact dedup -----------------------------------------------------------------------------


def brute_exact(rows):
    groups = {}
    for key, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((key, text or ""))
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        left = sum(m[0] == best[0] and len(m[1]) == len(best[1]) for m in members) and 1
        for key, text in sorted(members, key=lambda m: len(m[1])):
            stays = key == best[0] and len(text) == len(best[1]) and left > 0
            left -= stays
            out.append((key, best[0], len(members), stays, hashlib.sha256(norm.encode()).hexdigest()))
    return Counter(out)


def marked(df):
    return Counter(tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def test_exact_against_brute_force(odd_docs, rows):
    assert marked(exact_dedup.mark(odd_docs)) == brute_exact([r[:2] for r in rows])


def test_exact_without_repeated_keys(spark, rows):
    unique = [r[:2] for i, r in enumerate(rows) if r[0] is not None and i != 3]
    docs = spark.createDataFrame(unique, "doc_id bigint, text string")
    assert marked(exact_dedup.mark(docs)) == brute_exact(unique)


def test_exact_tells_clashing_hashes_apart(odd_docs, rows):
    weak = exact_dedup.mark(odd_docs, digest=lambda sha: F.substring(sha, 1, 1))
    assert marked(weak) == brute_exact([r[:2] for r in rows])
    assert marked(exact_dedup.mark(odd_docs, digest=lambda sha: F.lit("same"))) == brute_exact([r[:2] for r in rows])


def test_exact_rows_that_stay(odd_docs, rows):
    kept = exact_dedup.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in rows})


def test_exact_of_nothing(no_docs):
    assert exact_dedup.mark(no_docs).count() == 0 and exact_dedup.deduplicated(no_docs).columns == no_docs.columns


def test_exact_with_extreme_keys(spark):
    top = 2**63 - 1
    rows = [(top, "x"), (-top - 1, "x"), (0, "x ")]
    got = marked(exact_dedup.mark(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert got == brute_exact(rows)


# ---- SimHash ---------------------------------------------------------------------------------


def naive_fingerprint(text, words=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    tokens = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint(rows):
    for text in [r[1] for r in rows] + ["a", "A b", "x y z", "É A\x85b", "x y z x y z x y"]:
        assert simhash.fingerprint(text) % (1 << 64) == naive_fingerprint(text)


def test_fingerprint_of_many_chunks():
    rng = random.Random(2)
    text = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(simhash.CHUNK * 2 + 5))
    assert simhash.fingerprint(text) % (1 << 64) == naive_fingerprint(text)


def flipped(value, bits):
    for b in bits:
        value ^= 1 << b
    return value - (1 << 64) if value >= 1 << 63 else value


def check_links(spark, prints, max_bits):
    prints = sorted(set(prints))
    got = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp bigint"), max_bits)
    edges = {tuple(r) for r in got.collect()}
    want = reachable(prints, lambda x, y: ((x ^ y) & ((1 << 64) - 1)).bit_count() <= max_bits)
    around = {p: set() for p in prints}
    for a, b in edges:
        around[a].add(b)
        around[b].add(a)
    assert reachable(prints, lambda x, y: y in around[x]) == want
    return edges


def test_links_of_sparse_fingerprints(spark):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(60)]
    prints = [flipped(s, rng.sample(range(64), n)) for s in seeds for n in (0, 1, 2, 3, 4)]
    for max_bits in (0, 1, 2):
        edges = check_links(spark, prints, max_bits)
        assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= max_bits for a, b in edges)


def test_links_of_a_crowd(spark):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    crowd = [flipped(centre, rng.sample(range(64), rng.randrange(4))) for _ in range(400)]
    for max_bits in (1, 2):
        check_links(spark, crowd + [flipped(rng.getrandbits(64), []) for _ in range(50)], max_bits)


def test_simhash_against_brute_force(spark, odd_docs, rows):
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.mark(odd_docs).collect()}
    prints = {naive_fingerprint(r[1]) for r in rows}
    root = reachable(prints, lambda x, y: (x ^ y).bit_count() <= 2)
    for key, text, *_ in rows:
        fp = naive_fingerprint(text)
        keys = [r[0] for r in rows if root[naive_fingerprint(r[1])] == root[fp] and r[0] is not None]
        assert got[key, f"{fp:016x}"] == (min(keys) if keys else None)


def test_simhash_one_of_each_group_stays(odd_docs):
    kept = simhash.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    keys = [r["doc_id"] for r in kept.collect()]
    # Equal texts under 10, 11, 12 and no key; empty ones under 13, 14, 15.
    assert sorted(k for k in keys if k is not None) == [-3, 10, 13, 16, 17, 18, 19]


def test_simhash_of_nothing(no_docs):
    assert simhash.mark(no_docs).count() == 0 and simhash.deduplicated(no_docs).count() == 0
