"""SimHash near-dedup: pivot distance tables over 64-bit fingerprints.

A fingerprint has a bit set when more than half of the document's shingle hashes (XXH64, seed 42)
have it set. Two fingerprints link when at most ``max_bits`` bits differ.

Links are found through distances to reference fingerprints (pivots). Distances never differ by
more than the two fingerprints do, so a pair whose distances to one pivot differ by more than
``max_bits`` is no link. The bits are also cut into ``max_bits + 2`` blocks: the differing bits of a
link leave two blocks untouched, and over those blocks the distances to every pivot agree. So for
each pair of blocks the row of 20 pivot distances is a join key that loses nothing. Pairs of one
key pass the table of whole distances (largest coordinate difference), and the survivors are
verified bit by bit.

A key that many fingerprints share (one document in thousands of versions) is not paired out. Two
fingerprints are at most two bits apart exactly when some reference point lies within one bit of
both, so there the references are the points around each fingerprint: members at distance 0 or 1
from one reference are linked to the first of them. The work stays a fixed factor of the members.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import components, stored

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
# Shingle hashes held at once while a text of any length is counted.
CHUNK = 1 << 15
# Members of a key up to which pairs are compared; beyond it, reference points cost less than pairs.
PAIRED = 48


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit fingerprint of a whole text; null and blank texts give zero."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = memoryview(b" ".join(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words, len(tokens))
    first, last = starts[: len(tokens) - width + 1], ends[width - 1 :]
    set_bits = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(first), CHUNK):
        spans = zip(first[at : at + CHUNK].tolist(), last[at : at + CHUNK].tolist(), strict=True)
        hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], dtype=">u8")
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * set_bits > len(first)).astype(np.uint8)
    return int(np.packbits(bits).view(">i8")[0])


def fingerprint_column(text: Column, words: int = SHINGLE_WORDS) -> Column:
    @F.pandas_udf("bigint")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return prints(text)


def _blocks(count: int) -> list[int]:
    """Bit masks of ``count`` blocks that together cover 64 bits."""
    edges = [64 * i // count for i in range(count + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _masked(mask: int) -> Column:
    return F.col("fp").bitwiseAND(F.lit(_signed(mask)))


def _distance(fp: Column, pivot: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(_signed(pivot))))


def pivots(count: int = 20) -> list[int]:
    """Reference fingerprints: unrelated bit patterns, the same in every run."""
    return [xxhash.xxh64_intdigest(str(i), 7) for i in range(count)]


def _row(mask: int) -> Column:
    """Distances over the bits of ``mask`` (at most 63 of them) to all pivots, six bits each."""
    packed = []
    for some in (pivots()[:10], pivots()[10:]):
        cells = [F.shiftleft(_distance(_masked(mask), p & mask).cast("bigint"), 6 * i) for i, p in enumerate(some)]
        packed.append(reduce(lambda a, b: a.bitwiseOR(b), cells))
    return F.struct(*packed)


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(a, b)`` between different fingerprints of ``distinct(fp)``; every link is an edge or a path of edges.

    ``max_bits`` is at most 2: the reference points of a crowded key lie within one bit.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("links are found for 0, 1 or 2 differing bits")
    blocks = _blocks(max_bits + 2)
    pairs = list(combinations(range(len(blocks)), 2))
    keyed = distinct.select(
        "fp",
        F.posexplode(F.array(*[_row(blocks[i] | blocks[j]) for i, j in pairs])).alias("table", "cell"),
    )
    sizes = keyed.groupBy("table", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(keyed.join(sizes, ["table", "cell"]), "simhash-cells")

    few = members.where(F.col("n") <= PAIRED).withColumn(
        "far", F.array(*[_distance(F.col("fp"), p).cast("tinyint") for p in pivots()])
    )
    x, y = few.alias("x"), few.alias("y")
    near = (
        x.join(y, (F.col("x.table") == F.col("y.table")) & (F.col("x.cell") == F.col("y.cell")) & (F.col("x.fp") < F.col("y.fp")))
        .where(
            F.greatest(*[F.abs(F.col("x.far")[i] - F.col("y.far")[i]) for i in range(len(pivots()))]) <= max_bits
        )
        .where(_distance(F.col("x.fp").bitwiseXOR(F.col("y.fp")), 0) <= max_bits)
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    )

    flips = [
        F.when(_masked(1 << bit) == F.lit(0), F.col("fp").bitwiseOR(F.lit(_signed(1 << bit)))).otherwise(
            _masked(((1 << 64) - 1) ^ (1 << bit))
        )
        for bit in range(64)
    ] if max_bits else []
    crowd = members.where(F.col("n") > PAIRED).select("fp").distinct()
    reach = crowd.select("fp", F.explode(F.array(F.col("fp"), *flips)).alias("point"))
    firsts = reach.groupBy("point").agg(F.min("fp").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    if max_bits == 1:
        firsts = firsts.join(crowd.select(F.col("fp").alias("point")), "point", "left_semi")
    around = reach.join(firsts, "point").where("fp != first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    return near.union(around).distinct()


def mark(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: key, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest key reachable by links, the row's own included. Null and blank
    texts have fingerprint zero and link like any other. Rows that repeat a key get the same
    answer if their texts agree. Null keys never become a ``component_id`` unless a component has
    nothing else, where it is null. An empty table gives no rows; other columns are ignored.
    """
    prints = docs.select(F.col(f"`{key}`").alias("__id"), fingerprint_column(F.col(f"`{text}`"), words).alias("fp"))
    prints = stored(prints, "simhash-prints")
    distinct = stored(prints.groupBy("fp").agg(F.min("__id").alias("least")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), max_bits), "simhash-components")
    rooted = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select(
        F.col("__id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` whose key is their component's id: one document of each group stays.

    Rows that repeat that key all stay (``exact_dedup`` removes copies); rows with a null key stay
    only where their whole component has null keys.
    """
    marked = mark(docs, key, text, words, max_bits)
    stay = marked.where(F.col(f"`{key}`").eqNullSafe(F.col("component_id"))).select(F.col(f"`{key}`").alias("__stay")).distinct()
    return docs.join(stay, F.col(f"`{key}`").eqNullSafe(F.col("__stay")), "left_semi")
