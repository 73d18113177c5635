"""Periodic runs against every period tried at every place."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftline.llm import periodic
from driftline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_runs(words):
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] == words[i + q]:
                j = i
                while j + q < n and words[j] == words[j + q]:
                    j += 1
                if j + q - i >= max(6, 4 * q):
                    out.setdefault((i, j + q), q)
                i = j
            i += 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def test_transform_round_trip_and_product():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, periodic.PRIME, (2, 3, 16), dtype=np.uint64)
    assert (periodic.backward(periodic.forward(x)) == x).all()
    product = periodic.backward(periodic._reduced(periodic.forward(x) * periodic.forward(y)))
    plain = [[sum(int(a[i]) * int(b[(k - i) % 16]) for i in range(16)) % periodic.PRIME for k in range(16)] for a, b in zip(x, y, strict=True)]
    assert product.tolist() == plain


@pytest.mark.parametrize("length", [1, 2, 4, 8])
def test_matches_are_the_zero_mismatch_places(length):
    words = np.random.default_rng(length).integers(0, 2, 200)
    codes = np.concatenate((np.array([7, 1 << 30], np.uint64)[words], np.full(3 * length, 5, np.uint64)))
    starts = np.arange(0, 200 - length, length)
    row, d = periodic.matches(codes, starts, length)
    plain = {(i, k) for i, s in enumerate(starts) for k in range(length, 2 * length) if (codes[s : s + length] == codes[s + k : s + k + length]).all()}
    assert set(zip(row.tolist(), d.tolist(), strict=True)) == plain


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 9)), max_size=12))
def test_all_runs(parts):
    words = [w for block, times in parts for w in block * times]
    if words:
        assert periodic.find_runs(np.array(words, np.int32)) == plain_runs(words)


def test_long_texts():
    plain = list(range(1000))
    assert periodic.find_runs(np.array([0] * 100_000 + [1] + [0] * 100_000)) == [(0, 100_000, 1), (100_001, 100_000, 1)]
    assert periodic.find_runs(np.array(plain * 50 + [7] * 5 + [1000 + i for i in plain])) == [(0, 50_000, 1000)]
    a, b = [0], [0, 1]
    while len(b) < 5000:
        a, b = b, b + a
    assert periodic.find_runs(np.array(b)) == plain_runs(b) == []


def test_texts_of_a_batch_do_not_mix():
    texts = [b"a b a b a b", b"a b a b", b"", b"x " * 9, b"x", b" \n"]
    batch = periodic.Batch.of(texts)
    assert batch.runs() == [[], [], [], [(0, 9, 1)], [], []]
    assert [batch.collapsed(i, r) for i, r in enumerate(batch.runs())] == [b"a b a b a b", b"a b a b", b"", b"x", b"x", b""]


def test_pieces_of_long_texts():
    text = (b"word " * 700 + b"\t") * 3 + b"y" * 50
    assert b" ".join(b" ".join(p.split()) for p in periodic.pieces(text, 100)) == b" ".join(text.split())
    assert list(periodic.pieces(b"x" * 500, 100)) == [b"x" * 500]


def test_odd_rows(spark, odd_docs, no_docs):
    out = periodic.runs(odd_docs)
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"] and out.count() == odd_docs.count()
    rows = {r["doc_id"]: r for r in out.collect()}
    assert [tuple(r) for r in rows[16]["runs"]] == [(0, 60_000, 1)] and rows[16]["collapsed"] == "word end"
    assert rows[13]["collapsed"] == rows[14]["collapsed"] == rows[15]["collapsed"] == "" and rows[13]["runs"] == []
    assert rows[11]["collapsed"] == "One two three four five six." and rows[17]["n_words"] == 5
    assert periodic.runs(no_docs).count() == 0 and periodic.summary(periodic.runs(no_docs)).count() == 0
    keyless = odd_docs.where("doc_id IS NULL").select("doc_id", periodic.planted(odd_docs).alias("t"), "text")
    assert keyless.where("t = text").count() == 2


def test_registered_query(spark):
    got = {r["doc_id"]: r for r in QUERIES["op13_periodic"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    checked = 0
    for doc in docs:
        words = re.findall("[^\x20\x09-\x0d]+", doc["text"] or "")
        h = zlib.crc32(str(doc["doc_id"]).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 2000:
            continue
        runs, out = plain_runs(words), got[doc["doc_id"]]
        kept = [True] * n
        for s, length, q in runs:
            kept[s + q : s + length] = [False] * (length - q)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        assert (out["n_runs"], out["start"], out["length"], out["period"]) == (len(runs), *best)
        assert out["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert out["runs_sha256"] == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        collapsed = " ".join(w for w, keep in zip(words, kept, strict=True) if keep)
        assert out["collapsed_sha256"] == hashlib.sha256(collapsed.encode()).hexdigest()
        checked += bool(runs)
    assert checked > 10
