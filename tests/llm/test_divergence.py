"""The audit against plain counting, and against its SQL."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftline.llm import divergence
from driftline.llm.queries import ORACLES, QUERIES
from tests import compare

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_audit(rows, least=3, listed=200):
    """Every term of every two sources priced by itself. ``rows`` are (text, lang, source)."""
    here, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        here[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = Counter({t: sum(here[lang, s][t] for s in sources) for t in kept})

        def share(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        price = lambda p, q: (p - q) * (p - q) // q
        shares, q = {s: share(here[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(x, sum(price(shares[s][t], shares[x][t]) for t in kept)) for x in sources if x != s]
            terms = [(t, price(shares[s][t], q[t])) for t in kept if here[lang, s][t] and shares[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, listed)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, i) for i, (item, value) in enumerate(items[:most], 1)}
    return out


def as_set(df):
    rows = df.collect()
    out = {tuple(r) for r in rows}
    assert len(out) == len(rows)
    return out


def docs_of(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, text string, lang string, source string")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=3, max_size=3), min_size=1, max_size=40), st.sampled_from([1, 3, 100]))
def test_joint_tables_count_all_rows(rows, tile):
    counts = np.array(rows, np.int64)
    places, owner, level = divergence.indicators(counts)
    got = Counter()
    for a, b, terms in divergence.joint_tables(places, owner, tile):
        for i, k, n in zip(a.tolist(), b.tolist(), terms.tolist(), strict=True):
            got[owner[i], level[i], owner[k], level[k]] += n
    want = Counter((g, r[g], h, r[h]) for r in rows for g in range(3) for h in range(g + 1, 3))
    assert got == want


def test_terms_are_cut_alike_in_pieces():
    text = ("Grüße an alle_Leute, ABC1def " * 40 + "x" * 300 + "É" * 300 + " \x00[end]").encode()
    whole = text.translate(divergence._FOLD).split()
    assert whole == [t.encode() for t in TERM.findall(text.decode().translate(LOWER))]
    for limit in (1, 7, 64, 1000, 10**6):
        assert b" ".join(divergence.pieces(text, limit)).split() == whole


@pytest.mark.parametrize("cells", [1, 1 << 14])
def test_against_plain_counting(spark, cells):
    words = ["Alpha", "beta", "gamma", "delta", "été", "straße", "ALPHA", "zeta"]
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(120):
        text = " ".join(words[k] for k in np.minimum(rng.geometric(0.3, rng.integers(0, 30)) - 1, 7))
        rows.append((text, "en" if rng.random() < 0.7 else "de", "abcde"[rng.integers(0, 5)]))
    rows += [(None, "en", "empty"), ("", "en", None), ("one two", "fr", "x"), ("three", "fr", "y"), (None, None, None), ("solo " * 5, "it", "a")]
    out = divergence.audit(docs_of(spark, rows).withColumns({"term": F.lit(1), "n": F.lit("n"), "block": F.lit(2)}), block_cells=cells)
    assert as_set(out) == plain_audit(rows)


def test_long_lists_are_cut_by_rank(spark):
    names = ["".join(chr(97 + int(c)) for c in str(i)) for i in range(300)]
    rows = [(" ".join(names), "en", "a")] * 3 + [("b " * 50, "en", "b")]
    out = divergence.audit(docs_of(spark, rows))
    assert as_set(out) == plain_audit(rows)
    assert out.where("part = 'term' AND source = 'a'").count() == 200


def test_handing_on_partial_counts_changes_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    whole = as_set(divergence.counted(docs))
    monkeypatch.setattr(divergence, "HELD_COUNTS", 50)
    assert as_set(divergence.counted(docs)) == whole


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["text"], r["lang"], r["source"]) for r in odd_docs.collect()]
    assert as_set(divergence.audit(odd_docs)) == plain_audit(rows)
    assert divergence.audit(no_docs).columns == ["lang", "source", "part", "item", "value", "rank"]
    assert divergence.audit(no_docs).count() == 0
    blank = docs_of(spark, [(None, "en", "a"), ("", "en", "b"), (" 1 ", "en", None)])
    assert as_set(divergence.audit(blank)) == plain_audit([(None, "en", "a"), ("", "en", "b"), (" 1 ", "en", None)])


def test_large_counts_stay_exact(spark):
    count, total, kept = 9 * 10**13, 10**14, 12345
    row = spark.range(1).select(divergence.probability(F.lit(count), F.lit(total), F.lit(kept)).alias("p"))
    assert row.first()["p"] == 1 + 10**9 * (count + 1) // (total + kept)
    assert spark.range(1).select(divergence.price(F.lit(10**9 + 1), F.lit(1)).alias("f")).first()["f"] == 10**18


def test_registered_query(spark):
    got = compare.spark_rows(QUERIES["op11_divergence"](spark, SF))
    assert compare.difference(got, compare.sql_rows(compare.connect(SF), ORACLES["op11_divergence"])) is None
