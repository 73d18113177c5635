import re
from collections import Counter, defaultdict

import corpus_pipeline
from driftline.llm import quality
from tests.llm.test_dedup import brute_exact, naive_fingerprint, reachable
from tests.llm.test_mix_and_pack import fill, words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data).persist()
        outs.append(docs.collect())
        assert name == "packing" or docs.columns == COLUMNS
    good, exact, near, mix, packed = outs

    # Quality: exactly the documents that reach the threshold.
    all_docs = spark.read.parquet(f"{data}/documents.parquet")
    model = quality.train(all_docs, spark.read.parquet(f"{data}/labels.parquet"))
    passed = {r["doc_id"] for r in quality.scored(all_docs, model).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in good} == passed and 0 < len(passed) < all_docs.count()

    kept = {key for key, _, _, stays, _ in brute_exact([(r["doc_id"], r["text"]) for r in good]) if stays}
    assert sorted(r["doc_id"] for r in exact) == sorted(kept)

    prints = {r["doc_id"]: naive_fingerprint(r["text"]) for r in exact}
    root = reachable(set(prints.values()), lambda x, y: (x ^ y).bit_count() <= 2)
    first = {}
    for key in sorted(prints):
        first.setdefault(root[prints[key]], key)
    assert sorted(r["doc_id"] for r in near) == sorted(first.values())

    size, taken = defaultdict(int), defaultdict(int)
    for r in near:
        size[r["source"]] += words(r["text"])
    for r in mix:
        taken[r["source"]] += words(r["text"])
    names = sorted(size)
    target = fill(dict(size), {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5, 2.0)
    # Texts are never cut: the last document of a source is in or out, whichever is nearer.
    widest = {s: max(words(r["text"]) for r in near if r["source"] == s) for s in names}
    assert all(abs(taken[s] - target[s]) <= widest[s] / 2 + 0.5 for s in names)
    assert {tuple(r) for r in mix} <= {tuple(r) for r in near}

    assert sum(r["n_words"] for r in packed) == sum(taken.values())
    got = Counter(r["doc_id"] for r in packed if r["piece"] == 0)
    assert got == Counter(r["doc_id"] for r in mix if re.search(r"[^\x20\x09-\x0D]", r["text"] or ""))


def test_run_is_the_stages(spark, data):
    once = sorted(tuple(r) for r in corpus_pipeline.run(spark, data).collect())
    assert once == sorted(tuple(r) for r in corpus_pipeline.run(spark, data).collect()) and once


def test_pipeline_of_odd_rows(spark, odd_docs, folder):
    odd_docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(10, 1), (17, 1), (16, 0), (None, None)], "doc_id bigint, quality int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).columns[0] == "doc_id"


def test_pipeline_of_nothing(spark, no_docs, folder):
    no_docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_entry_registers_all():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert set(entry.oracle_sql()) <= names
