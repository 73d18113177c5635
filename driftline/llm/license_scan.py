"""License scans: base phrases by word position, and an exact set-similarity join with notices.

A text block (a line) matches a notice when it holds at least ``CONTAINMENT`` of the notice's
distinct words. All such pairs are found, without comparing all:

* the notices' words are ordered by how often the whole corpus uses them, rarest first;
* prefix filter: a block with enough of a notice's words has one of its rarest
  ``size - needed + 1`` words, so blocks join notices on those words only;
* length filter: the block has at least ``needed`` of the words that any notice uses;
* positional filter: after the first shared word, enough words are left on both sides;
* the pairs that are left are verified by intersecting the word sets.

Notices that are wrapped over lines have no block of their own. With ``windows`` a block is instead
every run of a notice's length of consecutive words, line ends or not, and a notice's label is given
only where the run also holds the words that tell its version or variant from others.

Notices are a parameter of known size, so they are broadcast; blocks never meet one another. Only
DataFrame operations.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import ascii_lower, stored

# Words are runs of other characters than these, after A-Z is lowered.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAINMENT = 0.8

# Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Customary notices and the labels they add.
NOTICES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "You may not use this file except in compliance with the License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("all-rights-reserved", "All rights reserved."),
]

# Words that stand together in a notice and tell it from notices of other versions or variants.
VARIANTS = [
    "apache", "mit", "mozilla", "gnu general", "public license version 2", "public license version 3", "2 0",
    "cc by 4 0", "cc by sa 4 0", "cc by nc 4 0", "attribution 4 0",
]


def words_of(text: str) -> list[str]:
    return re.findall(WORD, re.sub("[A-Z]+", lambda m: m.group().lower(), text))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _phrase_pattern(phrases: list[str]) -> str:
    start, end = r"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])", r"(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])"
    return f"{start}(?:{'|'.join(p.replace(' ', GAP) for p in phrases)}){end}"


def _places(phrase: str) -> Column:
    """Word numbers at which the phrase's words stand consecutively in ``__words``."""
    words = F.col("__words")

    def here(i: Column) -> Column:
        tests = [F.get(words, i + k) == w for k, w in enumerate(phrase.split(" "))]
        found = tests[0]
        for test in tests[1:]:
            found = found & test
        return F.coalesce(found, F.lit(False))

    first, more = phrase.split(" ")[0], len(phrase.split(" ")) - 1
    spots = F.when(F.size(words) > more, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(F.array_contains(words, first), F.filter(spots, here)).otherwise(F.array().cast("array<int>"))


def base(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES) -> DataFrame:
    """``__id, __same`` (a hash of the text), ``n_words, n_base, first_word, last_word`` and the label array ``__base``."""
    read = docs.select(F.col(f"`{key}`").alias("__id"), ascii_lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("__t"))
    read = read.withColumn("__hit", F.col("__t").rlike(_phrase_pattern(list(phrases))))
    # Words are numbered only where a phrase stands.
    read = read.select(
        "__id", F.xxhash64("__t").alias("__same"),
        F.regexp_count("__t", F.lit(WORD)).cast("bigint").alias("n_words"),
        F.when(F.col("__hit"), _words(F.col("__t"))).alias("__words"),
    )
    return _numbered(read, phrases)


def _numbered(read: DataFrame, phrases: dict[str, str], *more: str) -> DataFrame:
    """The columns of :func:`base` from ``__words`` (null where no phrase stands), and ``more`` of ``read``."""
    read = read.withColumns({f"__p{i}": F.when(F.col("__words").isNotNull(), _places(p)) for i, p in enumerate(phrases)})
    each = [F.coalesce(F.col(f"__p{i}"), F.array().cast("array<int>")) for i in range(len(phrases))]
    read = read.withColumn("__all", F.concat(*each))
    labels = F.array(*[F.when(F.size(p) > 0, F.lit(label)) for p, label in zip(each, phrases.values(), strict=True)])
    return read.select(
        "__id", "__same", "n_words", F.size("__all").cast("bigint").alias("n_base"),
        F.array_min("__all").cast("bigint").alias("first_word"), F.array_max("__all").cast("bigint").alias("last_word"),
        F.array_compact(labels).alias("__base"), *more,
    )


def _lowered(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").alias("__id"), ascii_lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("__t"))


def _prefixes(read: DataFrame, notices: list[tuple[str, str]], containment: float) -> tuple[list, dict, list, list]:
    """The notices' words from rare to frequent in ``read`` and their ranks, ``(rank, at, notice)`` of
    the prefixes, and ``(notice, label, ranks, needed)``. The filters are exact in any order of the words."""
    sets = [(label, set(words_of(t))) for label, t in notices]
    vocabulary = sorted(set().union(*(s for _, s in sets)) if sets else set())

    # One row per word of the notices.
    counted = read.select(F.explode(_words(F.col("__t"))).alias("w")).where(F.col("w").isin(vocabulary)).groupBy("w").count()
    counts = {r[0]: r[1] for r in counted.collect()}
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}

    prefix, whole = [], []
    for n, (label, words) in enumerate(sets):
        ranks = sorted(rank[w] for w in words)
        needed = max(1, math.ceil(containment * len(ranks) - 1e-9))
        whole.append((n, label, ranks, needed))
        prefix += [(r, at, n) for at, r in enumerate(ranks[: len(ranks) - needed + 1])]
    return order, rank, prefix, whole


def notice_matches(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    notices: list[tuple[str, str]] = NOTICES,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """``(__id, __same, __block, label, contained)``: every block and notice at or above the threshold.

    ``contained`` is the share of the notice's distinct words that the block holds.
    """
    spark = docs.sparkSession
    read = _lowered(docs, key, text)
    order, rank, prefix, whole = _prefixes(read, notices, containment)
    rare = sorted({order[r] for r, _, _ in prefix})
    prefixes = spark.createDataFrame(prefix, "rank int, at int, notice int")
    wholes = spark.createDataFrame(whole, "notice int, label string, ranks array<int>, needed int")
    joined = prefixes.join(wholes, "notice")

    blocks = read.where(F.col("__t").rlike(_phrase_pattern(rare))) if rare else read.where("false")
    blocks = blocks.select("__id", F.xxhash64("__t").alias("__same"), F.posexplode(F.split("__t", r"[\n\r]+")).alias("__block", "__line"))
    blocks = blocks.where(F.col("__line").rlike(_phrase_pattern(rare))) if rare else blocks
    # The block's words that notices use, as ranks: rarest first.
    ranks = F.create_map(*[x for w in order for x in (F.lit(w), F.lit(rank[w]))]) if order else F.lit(None).cast("map<string,int>")
    blocks = blocks.withColumn("__w", F.array_distinct(_words(F.col("__line"))))
    blocks = blocks.select(
        "__id", "__same", "__block",
        F.array_sort(F.array_compact(F.transform("__w", lambda w: ranks[w]))).alias("__r"),
    )
    probes = blocks.select("*", F.posexplode("__r").alias("__at", "rank"))
    found = probes.join(F.broadcast(joined), "rank").where(
        (F.size("__r") >= F.col("needed"))
        & (1 + F.least(F.size("__r") - F.col("__at") - 1, F.size("ranks") - F.col("at") - 1) >= F.col("needed"))
    )
    shared = F.size(F.array_intersect("__r", "ranks"))
    return (
        found.where(shared >= F.col("needed"))
        .select("__id", "__same", "__block", "notice", "label", (shared / F.size("ranks")).alias("contained"))
        .distinct()
    )


def _required(words: list[str], variants: list[str]) -> list[list[str]]:
    """The ``variants`` that stand in the notice's own words."""
    split = [v.split(" ") for v in variants]
    return [v for v in split if any(words[i : i + len(v)] == v for i in range(len(words)))]


def window_matches(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    phrases: dict[str, str] = PHRASES,
    notices: list[tuple[str, str]] = NOTICES,
    containment: float = CONTAINMENT,
    variants: list[str] = VARIANTS,
) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`base`, and ``(__id, __same, label, contained)``: notices in a run of consecutive
    words, across line ends.

    A run has as many words as the notice, at every place of the text (shorter only where the text
    is), and holds the notice's ``variants``. A run that matches has one of the notice's prefix
    words, so only the places around those are looked at. Words are ordered by how often all texts have
    them, which a pass of its own counts; then they are split once more, for both results.
    """
    spark = docs.sparkSession
    order, _, prefix, whole = _prefixes(_lowered(docs, key, text), notices, containment)
    rare = sorted({order[r] for r, _, _ in prefix})
    lists = [words_of(t) for _, t in notices]
    wide = max(map(len, lists), default=1)
    prefixes = spark.createDataFrame([(order[r], n) for r, _, n in prefix], "word string, notice int")
    wholes = spark.createDataFrame(
        [(n, label, [order[r] for r in ranks], needed, len(lists[n]), _required(lists[n], variants)) for n, label, ranks, needed in whole],
        "notice int, label string, words array<string>, needed int, span int, required array<array<string>>",
    )

    texts = _lowered(docs, key, text).select("__id", F.xxhash64("__t").alias("__same"), _words(F.col("__t")).alias("__words"))
    words = F.col("__words")
    spots = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(rare), i)))

    def around(i: Column) -> Column:
        start = F.greatest(i - (wide - 1), F.lit(0))
        return F.struct(F.get(words, i).alias("word"), (i - start).alias("at"), F.slice(words, start + 1, i - start + wide).alias("near"))

    texts = texts.select("*", F.size(words).cast("bigint").alias("n_words"), F.transform(spots, around).alias("__spots"))
    plain = stored(_numbered(texts, phrases, "__spots"), "license-words")
    near = plain.select("__id", "__same", F.explode("__spots").alias("__s"))
    near = near.select("__id", "__same", "__s.word", "__s.at", "__s.near")
    found = near.join(F.broadcast(prefixes.join(wholes, "notice")), "word")
    # All runs over the prefix word, then each of them.
    start = F.greatest(F.col("at") - F.col("span") + 1, F.lit(0))
    region = F.slice("near", start + 1, F.col("at") - start + F.col("span"))
    found = found.where(F.size(F.array_intersect(region, "words")) >= F.col("needed"))

    def together(run: Column, part: Column) -> Column:
        return F.exists(F.sequence(F.lit(1), F.size(run)), lambda i: F.slice(run, i, F.size(part)) == part)

    def shared(first: Column) -> Column:
        run = F.slice("near", first + 1, F.col("span"))
        n = F.size(F.array_intersect(run, "words"))
        return F.when((n >= F.col("needed")) & F.forall("required", lambda part: together(run, part)), n)

    best = F.array_max(F.transform(F.sequence(start, F.col("at")), shared))
    found = found.select("__id", "__same", "label", (best / F.size("words")).alias("contained"))
    return plain.drop("__spots"), found.where(F.col("contained").isNotNull())


def scan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    phrases: dict[str, str] = PHRASES,
    notices: list[tuple[str, str]] = NOTICES,
    containment: float = CONTAINMENT,
    windows: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: key, ``n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``labels`` joins the base labels and those of the notices found; ``score`` is the largest
    containment of a notice in a block, 0 where none reaches the threshold. A block is a line, or with
    ``windows`` a run of consecutive words. Null and empty texts
    have no words, empty labels and score 0. Rows equal in key and text get equal answers, null
    keys included. An empty table gives no rows; other columns are ignored.
    """
    if windows:
        plain, matches = window_matches(docs, key, text, phrases, notices, containment)
    else:
        plain, matches = base(docs, key, text, phrases), notice_matches(docs, key, text, notices, containment)
    by_row = (
        matches.groupBy(F.struct("__id", "__same").alias("__row"))
        .agg(F.collect_set("label").alias("__more"), F.max("contained").alias("__score"))
    )
    rows = plain.withColumn("__row", F.struct("__id", "__same")).join(by_row, "__row", "left")
    both = F.array_union("__base", F.coalesce("__more", F.array().cast("array<string>")))
    return rows.select(
        F.col("__id").alias(key), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("__base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(both), ",").alias("labels"),
        F.coalesce("__score", F.lit(0.0)).alias("score"),
    )
