"""One registered query per operator over its whole table, with SQL where SQL can say the same."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import bpe, divergence, embed_dedup, exact_dedup, langid, license_scan, mixing, packing, periodic, pii, quality, simhash, warc
from driftline.llm.common import stored
from driftline.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query(
    "op2_exact_dedup",
    r"""
    WITH t AS (
        SELECT doc_id, coalesce(text, '') AS text,
               regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
        FROM documents),
    w AS (
        SELECT *, count(*) OVER (PARTITION BY norm) AS group_size,
               first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id
        FROM t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w""",
)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(table(spark, sf_dir, "documents"))


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.mark(table(spark, sf_dir, "documents"))


@query(
    "op5_mixing",
    r"""
    WITH t AS (
        SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
               md5('11:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS ord
        FROM documents),
    s AS (
        SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS cap,
               [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
        FROM t GROUP BY source),
    a AS (
        SELECT *, sum(cap) OVER o AS caps, sum(w) OVER o AS ws, row_number() OVER o AS k FROM s
        WINDOW o AS (ORDER BY cap / w, source ROWS UNBOUNDED PRECEDING)),
    b AS (SELECT 1.5::DOUBLE * sum(source_size) AS budget, sum(w) AS total FROM s),
    -- the first k that clamps no one else: the level of the rest stays below the next cap
    steps AS (SELECT 0 AS k, 0.0::DOUBLE AS caps, 0.0::DOUBLE AS ws UNION ALL SELECT k, caps, ws FROM a),
    lvl AS (
        SELECT k, budget - steps.caps AS rest, total - steps.ws AS free
        FROM steps, b
        WHERE total - steps.ws > 0
          AND NOT EXISTS (SELECT 1 FROM a WHERE a.k = steps.k + 1
                          AND a.cap * (total - steps.ws) <= a.w * (budget - steps.caps))
        ORDER BY k LIMIT 1),
    g AS (
        SELECT source, source_size,
               CASE WHEN a.k <= lvl.k OR lvl.k IS NULL THEN cap ELSE rest * w / free END::DOUBLE AS target
        FROM a LEFT JOIN lvl ON true),
    r AS (
        SELECT t.doc_id, size, source_size, target,
               CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole,
               coalesce(sum(size) OVER (PARTITION BY t.source
                   ORDER BY substr(ord, 1, 15), t.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM t JOIN g ON t.source IS NOT DISTINCT FROM g.source)
    SELECT doc_id, size, source_size, target,
           (whole * size + greatest(0, least(size, round(target)::BIGINT - whole * source_size - before)))::BIGINT AS taken
    FROM r""",
)
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query(
    "op6_warc",
    r"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    d AS (
        SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha1(body) AS hex,
               min(page_id) OVER (PARTITION BY body) AS first
        FROM p),
    b AS (
        SELECT *, list_transform(range(0, 8), lambda g: ('0x' || substr(hex, 5 * g::INT + 1, 5))::BIGINT) AS parts FROM d)
    SELECT page_id, payload_bytes,
           array_to_string(list_transform(range(0, 32), lambda i:
               substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                      1 + ((parts[1 + i // 4] >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM b""",
)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers, payloads = warc.archive(table(spark, sf_dir, "pages"))
    path = scratch_path(spark, "warc-files")
    warc.write_files(warc.records(headers, payloads), path, compression="gzip")
    back = warc.verified(stored(warc.parsed(warc.read_files(spark, path)).drop("url", "body"), "warc-parsed"))
    sound = F.when(F.col("intact"), F.col("record_type")).otherwise(F.raise_error(F.lit("a record's bytes differ from its header")))
    return back.select("page_id", "payload_bytes", "payload_digest", sound.alias("record_type"), "refers_to")


def _license_sql() -> str:
    """The scan without its filters: every line's words against every notice's."""

    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    sets = [(n, label, sorted(set(license_scan.words_of(t)))) for n, (label, t) in enumerate(license_scan.NOTICES)]
    needed = [math.ceil(license_scan.CONTAINMENT * len(words) - 1e-9) for _, _, words in sets]
    notices = ", ".join(f"({n}, {text(label)}, {len(w)}, {k}, {w})" for (n, label, w), k in zip(sets, needed, strict=True))
    spots, labels = [], []
    for phrase, label in license_scan.PHRASES.items():
        tests = " AND ".join(f"w[i + {k}] = {text(x)}" for k, x in enumerate(phrase.split(" "), 1))
        spots.append(f"list_filter(range(0, len(w)), lambda i: {tests})")
        labels.append(text(label))
    each = ", ".join(f"{s} AS p{i}" for i, s in enumerate(spots))
    every = " || ".join(f"p{i}" for i in range(len(spots)))
    named = ", ".join(f"CASE WHEN len(p{i}) > 0 THEN {x} END" for i, x in enumerate(labels))
    return rf"""
    WITH t AS (
        SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
        FROM documents),
    b AS (SELECT doc_id, t, regexp_extract_all(t, '{license_scan.WORD}') AS w FROM t),
    p AS (SELECT doc_id, len(w) AS n_words, {each} FROM b),
    q AS (
        SELECT doc_id, n_words, {every} AS spots,
               list_filter([{named}], lambda x: x IS NOT NULL) AS base
        FROM p),
    lines AS (
        SELECT doc_id, list_distinct(regexp_extract_all(line, '{license_scan.WORD}')) AS w
        FROM (SELECT doc_id, unnest(regexp_split_to_array(t, '[\n\r]+')) AS line FROM t)
        WHERE regexp_matches(line, '[a-z]')),
    notices(n, label, size, needed, words) AS (VALUES {notices}),
    found AS (
        SELECT doc_id, label, len(list_intersect(w, words)) / size AS contained
        FROM lines, notices WHERE len(w) >= needed AND len(list_intersect(w, words)) >= needed),
    more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(contained) AS score FROM found GROUP BY doc_id)
    SELECT q.doc_id, n_words::BIGINT AS n_words, len(spots)::BIGINT AS n_base,
           list_min(spots)::BIGINT AS first_word, list_max(spots)::BIGINT AS last_word,
           array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
           array_to_string(list_sort(list_distinct(base || coalesce(more.labels, []))), ',') AS labels,
           coalesce(more.score, 0)::DOUBLE AS score
    FROM q LEFT JOIN more USING (doc_id)"""


@query("op3_license_scan", _license_sql())
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query("op3_license_windows")
def op3_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), windows=True)


@query(
    "op8_embed_dedup",
    """
    WITH RECURSIVE v AS (
        SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    ok AS (
        SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(e, lambda x: x <> 0)) > 0),
    link AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
    reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
    SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links,
           least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id,
           vec_id = least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS kept
    FROM v""",
)
def op8_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.mark(table(spark, sf_dir, "embeddings"))


@query("op9_langid")
def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.classified(docs, langid.train(docs))


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


@query(
    "op11_divergence",
    r"""
    WITH d AS (
        SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
        FROM documents),
    w AS (SELECT lang, source, r, unnest(words) AS term FROM d),
    g AS (SELECT DISTINCT lang, source FROM d),
    k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
    l AS (SELECT lang, sum(n)::HUGEINT AS n, count(*)::HUGEINT AS v FROM k GROUP BY lang),
    c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
    s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
    p AS (
        SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
               1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.n + l.v) AS p,
               1 + (1000000000::HUGEINT * (k.n + 1)) // (l.n + l.v) AS q
        FROM g JOIN k USING (lang) JOIN l USING (lang) JOIN s USING (lang, source)
        LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    pairs AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
               coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM p x JOIN p y USING (lang, term)
                         WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
        FROM (FROM pairs UNION ALL FROM terms))
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
)
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op12_bpe")
def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
    return bpe.summary(bpe.decoded(bpe.encoded(table(spark, sf_dir, "documents"), model), model))


@query("op13_periodic")
def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return periodic.summary(periodic.runs(docs, text=periodic.planted(docs)))
