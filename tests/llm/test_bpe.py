"""Encoding and decoding against the tokenizers library."""

import hashlib
import json

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from driftline.llm import bpe
from driftline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
MODEL = bpe.load(PATH)
# Parts that meet every branch of the word pattern, and some characters without a class of their own.
PARTS = ["a", "ab", "'", "s", "'ll", "re", " ", "  ", "\n", "\t", "é", "ß", "中", "1", "23", "²", ".", "!?", "<|endoftext|>", "<|end", " ",
         "\x1c", "\x85", " ", "\U0001f600", "̀", "the", " quick", "�", "\x00", "\U00010940", "՘"]


def library_ids(texts):
    return [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def own_ids(texts, encoder=None):
    ids, ends = (encoder or bpe.Encoder(MODEL)).texts(texts)
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), st.text(max_size=30)), max_size=6))
def test_same_ids_and_texts(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    ids = own_ids(texts)
    assert ids == library_ids(texts)
    for own, text in zip(ids, texts, strict=True):
        assert MODEL.decode(np.array(own, np.int64)).decode("utf-8", "replace") == text == LIBRARY.decode(own, skip_special_tokens=False)


def test_every_character():
    characters = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c}.{c} {c}{c}" for c in characters[k : k + 64]) for k in range(0, len(characters), 64)]
    assert own_ids(texts) == library_ids(texts)


def test_repeated_and_long_words():
    texts = ["a" * n for n in range(70)] + ["ab" * 50, " " * 40, "-" * 999, "abcdefghij" * 400, "x" * 20_000]
    assert own_ids(texts) == library_ids(texts)


def test_decoding_any_ids():
    rng = np.random.default_rng(3)
    for _ in range(200):
        ids = rng.integers(0, 50257, rng.integers(0, 12)).tolist()
        assert MODEL.decode(np.array(ids, np.int64)).decode("utf-8", "replace") == LIBRARY.decode(ids, skip_special_tokens=False)
    assert MODEL.decode(np.array([-1, 64, 10**6])) == MODEL.decode(np.array([64]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60).map("".join), st.sampled_from([1, 2, 5, 20]))
def test_pieces_keep_the_words(text, limit):
    assert [w for p in bpe.pieces(text, limit) for w in bpe.words_of(p)] == bpe.words_of(text)


def test_forgetting_changes_nothing(monkeypatch):
    texts = [f"word{i} of {i} <|endoftext|> again{i % 7}" for i in range(300)]
    monkeypatch.setattr(bpe, "KEPT_WORDS", 20)
    encoder = bpe.Encoder(MODEL)
    assert [own_ids([t], encoder)[0] for t in texts] == library_ids(texts)
    assert len(encoder.index) < 60
    assert own_ids(texts, encoder) == library_ids(texts)


def test_other_tokenizers_are_refused(tmp_path):
    with pytest.raises(ValueError):
        bpe.load(public_tokenizers.path("word_bpe_49k.json"))
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.load(str(tmp_path / "t.json"))


def test_odd_rows(spark, odd_docs, no_docs):
    rows = bpe.encoded(odd_docs, MODEL)
    assert rows.columns == ["doc_id", "ids"]
    out = bpe.decoded(rows, MODEL).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect() if r["doc_id"] is not None}
    assert len(out) == odd_docs.count()
    for r in out:
        if r["doc_id"] is not None:
            assert r["decoded"] == texts[r["doc_id"]] and r["ids"] == library_ids([texts[r["doc_id"]]])[0]
    assert bpe.summary(bpe.decoded(bpe.encoded(no_docs, MODEL), MODEL)).count() == 0
    holes = spark.createDataFrame([(1, [64, None, 65]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    assert [r["decoded"] for r in bpe.decoded(holes, MODEL).orderBy("doc_id").collect()] == [LIBRARY.decode([64, 65]), "", ""]


def test_registered_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {}
    for doc, ids in zip(docs, library_ids([d["text"] or "" for d in docs]), strict=True):
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[doc["doc_id"]] = (len(ids), digest(",".join(map(str, ids))), digest(text))
    got = QUERIES["op12_bpe"](spark, SF).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want and len(got) == len(docs)


def test_digest_in_steps():
    ids = np.arange(150_000)
    assert bpe.ids_digest(ids) == hashlib.sha256(",".join(map(str, range(150_000))).encode()).hexdigest()
