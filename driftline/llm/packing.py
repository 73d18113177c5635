"""Packing: optimal length buckets and token-budget batches.

Texts are cut into pieces of at most ``max_words`` words. A dynamic programme over the global
histogram of piece lengths (at most ``max_words`` bins) chooses the bucket bounds that pad least
in total. Inside a bucket every piece is padded to the bound, so a batch of ``budget`` words holds
``budget // bound`` pieces; pieces take their places in seeded order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import running_before, seeded_order, stored, word_count

MAX_WORDS = 4096
BUCKETS = 8
BUDGET = 32768
SEED = 23


def bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """At most ``buckets`` upper bounds, the largest length among them, with the least total padding.

    ``lengths`` are distinct and ascending. Padding is the sum of bound minus length over all
    pieces. Of equal solutions the one with fewer buckets, then with smaller bounds is taken.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    n = len(lengths)
    if n == 0:
        return []
    pieces = np.concatenate(([0], np.cumsum(counts)))
    words = np.concatenate(([0], np.cumsum(counts * lengths)))

    # best[j]: least padding of the first j lengths with the buckets so far. One more bucket over
    # lengths i..j-1 pads them all to lengths[j-1].
    best = np.concatenate(([0], lengths * pieces[1:] - words[1:]))
    choices: list[np.ndarray] = []
    for _ in range(1, min(buckets, n)):
        better, choice = best.copy(), np.full(n + 1, -1)
        for j in range(1, n + 1):
            cost = best[1:j] + lengths[j - 1] * (pieces[j] - pieces[1:j]) - (words[j] - words[1:j])
            if len(cost) and cost.min() < better[j]:
                choice[j] = 1 + int(cost.argmin())
                better[j] = cost[choice[j] - 1]
        choices.append(choice)
        best = better
    cut, j = [], n
    for choice in reversed(choices):
        if choice[j] > 0:
            cut.append(int(lengths[j - 1]))
            j = int(choice[j])
    cut.append(int(lengths[j - 1]))
    return sorted(cut)


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    max_words: int = MAX_WORDS,
    buckets: int = BUCKETS,
    budget: int = BUDGET,
    seed: int = SEED,
) -> DataFrame:
    """One row per piece: key, ``piece, first_word, n_words, bucket, batch, slot``.

    Piece ``i`` of a row holds its words ``first_word`` to ``first_word + n_words - 1``; a text
    without words (null, empty) has no piece and gives no row. ``bucket`` is the length its piece
    is padded to, ``batch`` numbers the batches of that bucket from 0 and ``slot`` the places in a
    batch. Every batch but a bucket's last is full, and ``bucket`` times its pieces is within
    ``budget`` (a bound above the budget has batches of one piece). Rows that repeat a key are
    packed each for itself. An empty table gives no rows; other columns are ignored.
    """
    long = F.col("__words")
    pieces = F.floor((long + (max_words - 1)) / F.lit(max_words)).cast("int")
    rows = (
        docs.select(
            F.col(f"`{key}`").alias("__id"), word_count(F.col(f"`{text}`")).alias("__words"),
            seeded_order(seed, F.col(f"`{key}`"), F.col(f"`{text}`")).alias("__order"),
        )
        .where(long > 0)
        .select("__id", "__words", "__order", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
        .withColumn("first_word", (F.col("piece") * max_words).cast("bigint"))
        .withColumn("n_words", F.least(long - F.col("first_word"), F.lit(max_words)).cast("int"))
        .withColumn("__order", F.shiftright(F.xxhash64("__order", "piece"), 4).bitwiseAND(F.lit((1 << 60) - 1)))
    )
    rows = stored(rows, "pack-rows")
    # At most max_words rows: the global histogram.
    histogram = rows.groupBy("n_words").count().orderBy("n_words").collect()
    cut = bounds(np.array([r[0] for r in histogram]), np.array([r[1] for r in histogram]), buckets)
    bucket = F.lit(cut[-1] if cut else 0)
    for bound in reversed(cut[:-1]):
        bucket = F.when(F.col("n_words") <= bound, F.lit(bound)).otherwise(bucket)
    places = running_before(
        rows.withColumns({"bucket": bucket, "__one": F.lit(1)}), "bucket", "__one", "__order", ["__id", "piece", "n_words"], "__place"
    )
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket"))).cast("bigint")
    return places.withColumn("__room", room).select(
        F.col("__id").alias(key), "piece", "first_word", "n_words", "bucket",
        F.floor(F.col("__place") / F.col("__room")).cast("bigint").alias("batch"),
        F.pmod("__place", "__room").cast("int").alias("slot"),
    )
