import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.llm import langid, pii, quality, queries, textbatch

SF = "/root/testdata/sf0.01"


# ---- text blocks -----------------------------------------------------------------------------


def test_blocks_hold_all_words():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é\n\t") for _ in range(rng.randrange(30))) for _ in range(200)] + ["", None, "x" * 5000]
    words = []
    for block in textbatch.blocks(texts, 100):
        starts, ends = block.words()
        data = block.data.tobytes()
        words += [data[a:b] for a, b in zip(starts, ends, strict=True)]
        hashes = textbatch.word_hashes(block.data, starts, ends)
        own = [data[a:b] for a, b in zip(starts, ends, strict=True)]
        assert len(set(hashes.tolist())) == len(set(own))
    assert words == [w for t in texts for w in (t or "").encode().split()]


# ---- quality ---------------------------------------------------------------------------------


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    out = quality.scored(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    assert len(out) > 40 and (out.predicted == out.quality).mean() > 0.93
    assert out[out.quality == 1].predicted.mean() > 0.97
    assert ((out.score >= 0.3) == (out.predicted == 1)).all()


def test_held_out_labels_and_other_columns_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn(
        "quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    a = quality.train(docs, labels)
    b = quality.train(docs.withColumns({"source": F.lit(None).cast("string"), "lang": F.lit("x")}), flipped)
    assert np.array_equal(a.weights, b.weights) and a.prior == b.prior


def test_non_negative_risk_separates():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(1, 1, (900, 6)), rng.normal(-1, 1, (900, 6))
    unlabelled = np.vstack((rng.normal(1, 1, (700, 6)), rng.normal(-1, 1, (300, 6))))
    model = quality.fit(good, unlabelled, 0.7)
    assert (model.score(good) > 0.5).mean() > 0.95 and (model.score(bad) < 0.5).mean() > 0.9


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(10, 1), (17, 1), (16, 0), (None, 1), (11, None), (10, 1)], "doc_id bigint, quality int")
    model = quality.train(odd_docs, labels.withColumn("text", F.lit("x")))
    out = quality.scored(odd_docs, model).collect()
    assert len(out) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] == 12}) == 1
    assert quality.accepted(odd_docs, model).columns == odd_docs.columns
    assert quality.scored(no_docs, model).count() == 0
    none = quality.train(no_docs, labels.limit(0))
    assert {r["score"] for r in quality.scored(odd_docs, none).collect()} == {0.5}


# ---- language --------------------------------------------------------------------------------


def test_held_out_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.classified(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(out) > 100 and (out.lang_pred == out.lang).mean() > 0.97
    assert out.score.between(0, 1).all() and out.confident.mean() > 0.9


def plain_grams(text):
    """Buckets of the byte 3- and 4-grams of a text and the blank behind it, one by one."""
    data = [b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode() + b"\n"]
    out = []
    for n, factors in ((3, (31, 1009, 65599)), (4, (37, 2027, 40503, 104729))):
        for i in range(len(data) - n + 1):
            gram = data[i : i + n]
            if set(gram) != {32}:
                mixed = (n + sum(b * f for b, f in zip(gram, factors, strict=True))) % 2**32
                out.append((mixed * 2654435761 % 2**32) >> 17)
    return out


def test_grams_and_scores_against_plain_code():
    texts = ["The quick brown fox", "", None, "été à la forêt, où?", "A1b2 C3", "x", "Straße 12 ÄÖÜ", "  \t "]
    rng = np.random.default_rng(1)
    model = langid.Model(["a", "b", "c"], rng.normal(0, 1, (langid.BUCKETS, 3)), rng.normal(0, 1, 3), 1.7, 0.4)
    for limit in (1, 30, 10**6):
        at = 0
        for block in textbatch.blocks(texts, limit):
            bucket, owner = langid.grams(block)
            p = model.probabilities(block)
            for i in range(len(block)):
                want = plain_grams(texts[at])
                assert sorted(bucket[owner == i].tolist()) == sorted(want)
                mean = [sum(model.table[b][k] for b in want) / max(1, len(want)) for k in range(3)]
                e = [math.exp((m + c) / model.temperature) for m, c in zip(mean, model.bias, strict=True)]
                assert np.allclose(p[i], [x / sum(e) for x in e])
                at += 1


def test_fit_descends_on_the_loss():
    """Two languages with grams of their own: the learned table gives each of its grams to its language."""
    texts = [(np.array([2 * k, 2 * k + 1, 100]), np.array([3.0, 1.0, 1.0])) for k in (0, 10)] * 40
    model = langid.fit(texts, np.array([0, 1] * 40), ["a", "b"])
    assert (model.table[[0, 1], 0] > model.table[[0, 1], 1]).all() and (model.table[[20, 21], 1] > model.table[[20, 21], 0]).all()


def test_a_language_of_one_repeated_id_is_learned(spark):
    """5,000 rows of one id beside 60 of others; the equal ones count once, the others by their texts."""
    rows = [(4, f"le petit chat numero {i} mange une souris", "fr") for i in range(300)] + [(4, "la meme phrase", "fr")] * 4700
    rows += [(i, f"the little dog number {i} eats a bone", "en") for i in range(60)]
    for shift in (1, 3, 4, 5):
        docs = spark.createDataFrame([(shift if k == 4 else k, t, y) for k, t, y in rows], "doc_id bigint, text string, lang string")
        if docs.where(langid.remainder(F.col("doc_id"), 4) != 2).where("lang = 'fr'").isEmpty():
            continue
        model = langid.train(docs)
        assert model.languages == ["en", "fr"]
        again = langid.train(docs.repartition(7))
        assert np.array_equal(model.table, again.table)


def test_too_many_languages_end_early(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    docs = spark.createDataFrame([(i, "some text", f"x{i}") for i in range(40)], "doc_id bigint, text string, lang string")
    with pytest.raises(ValueError, match="more than 3 values"):
        langid.train(docs)



def test_language_of_odd_rows(spark, odd_docs, no_docs):
    model = langid.train(odd_docs)
    out = {(r["doc_id"], r["lang_pred"], r["score"] == 0) for r in langid.classified(odd_docs, model).collect()}
    for key in (13, 14, 15):
        assert (key, "und", True) in out
    assert not any(lang == "und" for key, lang, _ in out if key in (10, 16, 17, 18))
    assert langid.classified(no_docs, model).count() == 0
    assert langid.train(no_docs) is None
    assert {r["lang_pred"] for r in langid.classified(odd_docs, None).collect()} == {"und"}


def test_every_language_is_learned(spark, data):
    """More than two hundred languages, each with words of its own; one of them has a single row."""
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}" * 4 for i in range(230)]
    each = [(n * 230 + i, f"{w} {w}", f"l{i}") for n in range(6) for i, w in enumerate(words)]
    docs = spark.createDataFrame([*each, (-4, "zzqqzzqq", "one")], "doc_id bigint, text string, lang string")
    assert set(langid.train(docs).languages) == {f"l{i}" for i in range(230)} | {"one"}
    out = queries.QUERIES["op9_langid"](spark, data)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score", "confident"]


def test_unlike_texts_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    odd = spark.createDataFrame([(1, "zzkx qqwv xxjz kkqz vvxq jjzk"), (2, "Ж" * 40)], "doc_id bigint, text string")
    assert not any(r["confident"] for r in langid.classified(odd, model).collect())


# ---- personal data ---------------------------------------------------------------------------


def plain_spans(text):
    """The patterns as they are written down."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@pytest.mark.parametrize("signs", ["a1.@+- ()9b%", "0123456789 -", "12.", "+1 ().-", "a@.-_%é"])
def test_base_spans(signs):
    rng = random.Random(signs)
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(45)))
        assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_of_long_runs():
    n = 400_000
    for text in ("1" * n, "a" * n, "a" * n + "@", "@" * n, "+" * n, "1." * n, "+1" + " " * n, "1 " * n, "a@a." * n):
        pii.base_spans(text)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    moves, begin = pii._allowed()
    field = pii.Field(np.zeros((1, pii.TAGS)), moves + rng.normal(size=moves.shape), begin + rng.normal(size=begin.shape))
    lengths = np.array([3, 1, 2, 3])
    score = rng.normal(size=(lengths.sum(), pii.TAGS)) * 2
    got, at = pii.viterbi(score, lengths, field), 0

    def worth(tags, rows):
        total = field.begin[tags[0]] + rows[0, tags[0]]
        return total + sum(field.moves[a, b] + r[b] for a, b, r in zip(tags, tags[1:], rows[1:]))

    for n in lengths:
        rows = score[at : at + n]
        paths = np.stack(np.meshgrid(*[np.arange(pii.TAGS)] * n), -1).reshape(-1, n)
        assert worth(got[at : at + n], rows) == pytest.approx(max(worth(p, rows) for p in paths))
        at += n


def test_lines_left_out_hold_nothing(monkeypatch):
    field = pii.trained()
    texts = [t for t, _ in pii.labelled_table(2)] + ["one two\nthree 12 four\n\nfive"]
    for block in pii.blocks(texts, 300):
        starts, ends = block.words()
        newlines = np.concatenate(([0], np.cumsum(block.data == 10)))[starts]
        first = np.concatenate(([True], newlines[1:] != newlines[:-1]))
        score = pii.emissions(field.weights, pii.shapes(block, starts, ends), first)
        sizes = np.diff(np.concatenate((np.flatnonzero(first), [len(starts)])))
        assert np.array_equal(pii.viterbi(score, sizes, field), pii.tags_of(block, starts, ends, field))


def test_field_on_held_out_variants(monkeypatch):
    """New digits and words for the labelled texts: most spans come back whole, clean texts stay clean."""
    field = pii.trained()
    table = pii.labelled_table(pii.VARIANTS + 3)
    per = pii.VARIANTS + 3
    held = [row for i, row in enumerate(table) if i % per >= pii.VARIANTS]
    monkeypatch.setattr(pii, "_checked", lambda kind, text: True)
    found, wanted, clean = 0, 0, 0
    at = 0
    for block in pii.blocks([t for t, _ in held]):
        for spans in pii.field_spans(block, field):
            want = set(held[at][1])
            found += len(want & set(spans))
            wanted += len(want)
            clean += not want and not spans
            at += 1
    assert found / wanted > 0.85 and clean / sum(not s for _, s in held) > 0.95


def test_field_adds_spans_and_keeps_base_ones():
    texts = pd.Series(["call (415) 555-0132 now", "4539.1488.0343.6467", "mail a@b.co é +1 (269) 555-3296", None, "", "no data here"])
    got = [(pii.written(b), pii.written(a)) for b, a in pii.all_spans(texts, pii.trained())]
    assert got[0] == ("", "phone:5:19")
    assert got[1][0] == "" and got[1][1] in ("", "card:0:19")
    assert got[2][0] == "email:5:11,phone:14:31" and set(got[2][0].split(",")) <= set(got[2][1].split(","))
    assert got[3:] == [("", "")] * 3


def test_pii_of_odd_rows(odd_docs, no_docs, rows):
    out = {(r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in pii.scan(odd_docs).collect()}
    for key, text, *_ in rows:
        kinds = [k for _, k, _ in plain_spans(text or "")]
        assert (key, *[kinds.count(k) for k in range(4)]) in out
    assert pii.scan(no_docs).count() == 0
