import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import embed_dedup, license_scan, queries, warc
from tests.compare import connect, difference, spark_rows, sql_rows

# ---- embeddings ------------------------------------------------------------------------------


def brute(rows, threshold):
    """Links by definition: ``(n_links, component)`` per row."""
    vectors = [np.array(v, float) if v and None not in v and np.isfinite(v).all() and any(v) else None for _, v in rows]
    n = len(rows)
    links = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i + 1, n):
            a, b = vectors[i], vectors[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= threshold:
                links[i].append(j)
                links[j].append(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        keys = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(links[i]), min(keys) if keys else None))
    return out


def planted(count, dims, per, cosines, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(count, dims))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    out = []
    for b in base:
        out.append(b)
        for _ in range(per):
            c = rng.choice(cosines)
            away = rng.normal(size=dims)
            away -= (away @ b) * b
            out.append(c * b + math.sqrt(1 - c * c) * away / np.linalg.norm(away))
    return [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(out)]


def marked(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("node", F.lit("x"))
    return embed_dedup.mark(df, **options).collect()


@pytest.mark.parametrize("block", [16, 1536])
def test_embeddings_against_brute_force(spark, block):
    rows = planted(60, 32, 4, (0.955, 0.97, 0.99), 1)
    got = marked(spark, rows, block=block)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == sorted(brute(rows, 0.95))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_recall_near_the_threshold(spark):
    rows = planted(300, 64, 2, (0.951, 0.955), 2)
    got = sum(r["n_links"] for r in marked(spark, rows))
    want = sum(n for _, n, _ in brute(rows, 0.95))
    assert 0.98 * want <= got <= want


def test_one_crowd_of_near_copies(spark):
    rows = planted(1, 16, 250, (0.999,), 3) + [(1000 + i, v) for i, v in planted(30, 16, 0, (1,), 4)]
    got = marked(spark, rows, block=40)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == sorted(brute(rows, 0.95))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 2.0, 3.0]
    rows = [
        (1, one), (2, [2.0, 4.0, 6.0]), (2, one), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [nan, 1.0, 1.0]), (7, [inf, 1.0, 1.0]),
        (8, [None, 1.0, 1.0]), (9, [1.0, 2.0]), (None, one), (None, None), (10, [1e30, 2e30, 3e30]), (11, [-1.0, -2.0, -3.0]),
        (12, [-0.0, 1.0, 0.0]), (13, [0.0, 1.0, 0.0]),
    ]
    got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in marked(spark, rows)]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(brute(rows, 0.95), key=key)
    assert marked(spark, []) == [] and len(marked(spark, [(1, None)])) == 1


# ---- licences --------------------------------------------------------------------------------


def brute_labels(text):
    """Every line against every notice."""
    labels, best = set(), 0.0
    for line in (text or "").replace("\r", "\n").split("\n"):
        have = set(license_scan.words_of(line))
        for label, notice in license_scan.NOTICES:
            want = set(license_scan.words_of(notice))
            if len(have & want) >= math.ceil(0.8 * len(want) - 1e-9):
                labels.add(label)
                best = max(best, len(have & want) / len(want))
    return labels, best


def brute_base(text):
    words = license_scan.words_of(text or "")
    places, labels = [], set()
    for phrase, label in license_scan.PHRASES.items():
        parts = phrase.split(" ")
        at = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        places += at
        labels |= {label} if at else set()
    return len(words), places, labels


TEXTS = [
    "GNU General Public License. gnu-general_public LICENSE gnu general public licenses",
    "ﬁn MIT License\nmit\nlicense cc by cc by",
    "xmit license, Émit license; mit licenseé",
    "Licensed under Apache License Version 2.0 and more words of all kinds",
    "Version 2.0 License, Apache: the under licensed\nReleased under an MIT License.",
    "All rights\nreserved.", "all RIGHTS reserved", "rights reserved rights", "İ K All rights reserved", "\r\rcc\rby\r", "gnu general public", "1",
]


def test_scan_against_brute_force(spark, odd_docs, rows):
    docs = [(r[0], r[1]) for r in rows] + [(100 + i, t) for i, t in enumerate(TEXTS)]
    df = odd_docs.select("doc_id", "text", "score", "kept", "row").unionByName(
        spark.createDataFrame(docs[len(rows) :], "doc_id bigint, text string"), allowMissingColumns=True
    )
    got = {
        (r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 9))
        for r in license_scan.scan(df).collect()
    }
    want = set()
    for key, text in docs:
        n, places, base = brute_base(text)
        more, best = brute_labels(text)
        ends = (min(places), max(places)) if places else (None, None)
        want.add((key, n, len(places), *ends, ",".join(sorted(base)), ",".join(sorted(base | more)), round(best, 9)))
    assert got == want


def test_scan_of_nothing(no_docs):
    assert license_scan.scan(no_docs).count() == 0


def brute_windows(text):
    """Every run of a notice's length against the notice."""
    words = license_scan.words_of(text or "")
    labels, best = set(), 0.0
    for label, notice in license_scan.NOTICES:
        want = license_scan.words_of(notice)
        padded = lambda ws: f" {' '.join(ws)} "
        required = [f" {v} " for v in license_scan.VARIANTS if f" {v} " in padded(want)]
        for i in range(max(1, len(words) - len(want) + 1)):
            run = words[i : i + len(want)]
            n = len(set(run) & set(want))
            if n >= math.ceil(0.8 * len(set(want)) - 1e-9) and all(v in padded(run) for v in required):
                labels.add(label)
                best = max(best, n / len(set(want)))
    return labels, best


WRAPPED = {
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that": "bsd",
    " * This Source Code Form is subject to the terms of the Mozilla Public\r\n * License, v. 2.0. If a copy": "mpl-2.0",
    "All rights\nreserved.": "all-rights-reserved",
    "all of us have rights here, and seats are reserved": "",
    "Licensed under CC BY-SA 4.0.": "cc-by-sa-4.0",
    "Licensed under CC\nBY 4.0.": "cc-by-4.0",
    "Licensed under CC BY 3.0.": "",
    "Released under the ISC License.": "",
    "This work is licensed under the GNU General Public License, version 2.": "gpl-2.0",
    "This work is licensed under the GNU Lesser General Public License, version 3.": "",
}


def test_scan_across_line_ends(spark, rows, no_docs):
    texts = [*WRAPPED, *TEXTS, *(r[1] for r in rows)]
    texts += [" ".join(["filler"] * i + license_scan.words_of(n)[: 20 - i] + ["end"] * (i % 3)) for i, (_, n) in enumerate(license_scan.NOTICES)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: (r["labels"], r["base_labels"], round(r["score"], 9)) for r in license_scan.scan(df, windows=True).collect()}
    for i, text in enumerate(texts):
        base, (more, best) = brute_base(text)[2], brute_windows(text)
        assert got[i] == (",".join(sorted(base | more)), ",".join(sorted(base)), round(best, 9))
        if text in WRAPPED:
            assert more == ({WRAPPED[text]} - {""})
    assert len(got) == len(texts) and license_scan.scan(no_docs, windows=True).count() == 0


def test_native_plan_across_line_ends(spark, data):
    plan = queries.QUERIES["op3_license_windows"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not any(bad in plan for bad in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))


# ---- WARC ------------------------------------------------------------------------------------

PAGES = [
    (5, "http://a", "same"), (3, "http://b", "same"), (9, None, "same"), (4, "http://c\r\nX: y", None), (6, "u", ""),
    (7, "u", "line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\né"), (8, "u", "x" * 300_000), (5, "http://a", "same"), (None, "n", "alone"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns(
        {c: F.lit("x") for c in ("digest", "body", "type", "size", "first")}
    )


def test_archive_round_trip(spark, folder):
    headers, payloads = warc.archive(pages(spark))
    assert payloads.count() == len({h or "" for _, _, h in PAGES})
    records = warc.records(headers, payloads)
    before = sorted(bytes(r[0]) for r in records.collect())
    warc.write_files(records, f"{folder}/warc", per_file=2)
    assert sorted(bytes(r[0]) for r in warc.read_files(spark, f"{folder}/warc").collect()) == before
    back = warc.parsed(warc.read_files(spark, f"{folder}/warc")).collect()
    assert all(r["intact"] for r in back) and len(back) == len(PAGES)
    bodies = {r["page_id"]: bytes(r["body"]).decode() for r in back if r["record_type"] == "response"}
    text = {key: html or "" for key, _, html in PAGES}
    for r in back:
        first = r["refers_to"] if r["record_type"] == "revisit" else r["page_id"]
        assert bodies[first] == text[r["page_id"]]
        assert r["payload_bytes"] == len(text[r["page_id"]].encode())


def test_archive_of_clashing_digests(spark):
    want = sorted(map(str, warc.parsed(warc.records(*warc.archive(pages(spark)))).collect()))
    weak = warc.archive(pages(spark), digest=lambda body: F.substring(F.sha2(body, 256), 1, 1))
    assert sorted(map(str, warc.parsed(warc.records(*weak)).collect())) == want


def test_small_payloads_are_responses(spark):
    back = warc.parsed(warc.records(*warc.archive(pages(spark), min_bytes=5))).collect()
    assert {r["page_id"] for r in back if r["record_type"] == "revisit"} == set()
    back = warc.parsed(warc.records(*warc.archive(pages(spark), min_bytes=4))).collect()
    assert {(r["page_id"], r["refers_to"]) for r in back if r["record_type"] == "revisit"} == {(5, 3), (9, 3)}


def test_damage_is_noticed(spark):
    headers, payloads = warc.archive(pages(spark))
    hurt = payloads.withColumn("body", F.concat("body", F.lit("!").cast("binary")))
    assert not any(r["intact"] for r in warc.parsed(warc.records(headers, hurt)).where("record_type = 'response'").collect())


def test_revisits_are_checked_against_files(spark, folder):
    headers, payloads = warc.archive(pages(spark))
    hurt = payloads.withColumn("body", F.when(F.col("body") == F.lit("same").cast("binary"), F.lit("sane").cast("binary")).otherwise(F.col("body")))
    for name, bodies in (("sound", payloads), ("hurt", hurt)):
        warc.write_files(warc.records(headers, bodies), f"{folder}/{name}", per_file=2, compression="gzip")
        back = warc.parsed(warc.read_files(spark, f"{folder}/{name}")).drop("body").persist()
        assert back.count() == len(PAGES)
        wrong = {r["page_id"] for r in warc.verified(back).where("NOT intact").collect()}
        same = {key for key, _, html in PAGES if html == "same"}
        assert wrong == (same if name == "hurt" else set())


def test_query_reads_archive_files(spark, data, monkeypatch):
    read, seen = warc.read_files, []
    monkeypatch.setattr(warc, "read_files", lambda s, path: seen.append(read(s, path)) or seen[-1])
    n = queries.QUERIES["op6_warc"](spark, data).count()
    assert len(seen) == 1 and seen[0].count() == n > 0


def test_archive_of_nothing(spark):
    headers, payloads = warc.archive(pages(spark, []))
    assert warc.parsed(warc.records(headers, payloads)).count() == 0


# ---- registered queries ----------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    got = spark_rows(queries.QUERIES[name](spark, data))
    assert got[1]
    if name in queries.ORACLES:
        assert difference(got, sql_rows(connect(data), queries.ORACLES[name])) is None


@pytest.mark.parametrize("name", ["op3_license_scan", "op5_mixing"])
def test_native_plans(spark, data, name):
    plan = queries.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    for bad in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan
