"""Embedding near-dedup: a pivot-permutation index.

A vector is described by its ``NEAREST`` nearest reference vectors (pivots), in order. Near vectors
have nearly the same neighbours among the pivots, so two vectors are candidates when they share at
least ``SHARED`` of them. Inverted lists, one per pivot, bring candidates together: ordered from
the rarest pivot to the most frequent, two vectors with enough shared pivots share one within the
first ``NEAREST - SHARED + 1``, so only those are posted. Inside a list the shared pivots are
counted and the candidates verified by cosine in double precision.

Lists are cut into blocks of bounded size that are compared two by two in numpy; what leaves a task
is one row per vector with links (how many, and the first vector of its local group), never the
pairs. Equal vectors are one entry of the index. The pivots are a bounded sample; all vectors are
indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import components, stored

THRESHOLD = 0.95
# Pivots: about the square root of the number of vectors, within these bounds.
PIVOTS = (64, 2048)
# Vectors drawn per pivot; pivots closer to one another than APART are not both used.
DRAWN = 4
APART = 0.7
NEAREST = 8
SHARED = 2
# Vectors of a block.
BLOCK = 1536


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; the scaling goes by the largest component first, so nothing overflows."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def padded(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : min(width, len(v))] = v[:width]
    return out


def choose_pivots(sample: list, count: int) -> np.ndarray:
    """Up to ``count`` unit vectors of the sample, none within ``APART`` of an earlier one."""
    if not sample:
        return np.zeros((0, 1))
    drawn = unit(padded(sample, max(map(len, sample))))
    kept = np.zeros((0, drawn.shape[1]))
    for v in drawn:
        if len(kept) == count:
            break
        if not len(kept) or (kept @ v).max() < APART:
            kept = np.vstack([kept, v])
    return kept


def linked_pairs(
    left: np.ndarray, right: np.ndarray, left_pivots: np.ndarray, right_pivots: np.ndarray, here: int, shared: int, threshold: float
) -> np.ndarray:
    """Row pairs of two blocks that share enough pivots, meet in list ``here`` first, and pass the cosine.

    Pivot numbers are ascending within a row; ``here`` is the smallest shared one for exactly one
    list, so a pair is found once.
    """
    names, at = np.unique(np.concatenate((left_pivots, right_pivots)), return_inverse=True)
    at = at.reshape(-1, left_pivots.shape[1])
    held = np.zeros((len(at), len(names)), np.float32)
    np.put_along_axis(held, at, 1, axis=1)
    a, b = held[: len(left)], held[len(left) :]
    earlier = names < here
    mask = (a @ b.T >= shared) & (a[:, earlier] @ b[:, earlier].T == 0)
    return np.argwhere(mask & (left @ right.T >= threshold))


def roots_of(pairs: np.ndarray, size: int) -> np.ndarray:
    """The smallest index reachable from each index."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        new = root.copy()
        np.minimum.at(new, root[pairs[:, 0]], low)
        np.minimum.at(new, root[pairs[:, 1]], low)
        np.minimum.at(new, pairs[:, 0], low)
        np.minimum.at(new, pairs[:, 1], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def mark(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    threshold: float = THRESHOLD,
    nearest: int = NEAREST,
    shared: int = SHARED,
    block: int = BLOCK,
    pivots: tuple[int, int] = PIVOTS,
) -> DataFrame:
    """One row per row of ``vectors``: key, ``n_links, component_id, kept``.

    ``n_links`` counts the other rows linked directly (cosine of at least ``threshold``, copies
    included), ``component_id`` is the smallest key reachable by links, the row's own included, and
    ``kept`` says that it is the row's own. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing. Vectors of different lengths do not link. Rows that
    repeat a key are rows of their own and all kept or not. Null keys never become a
    ``component_id`` unless there is nothing else, and then the row is kept. An empty table gives
    no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    v = F.col("__v")
    rows = vectors.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{vector}`").cast("array<double>").alias("__v"))
    sound = (
        F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    )
    rows = rows.withColumn("__v", F.when(sound, v))

    distinct = rows.where(v.isNotNull()).groupBy("__v").agg(F.min("__id").alias("least"), F.count(F.lit(1)).alias("copies"))
    distinct = stored(distinct.withColumn("node", F.monotonically_increasing_id()), "embed-distinct")
    total = distinct.count()
    count = min(pivots[1], max(pivots[0], int(total**0.5)))
    drawn = distinct.select("__v").orderBy(F.xxhash64("__v"), "__v").limit(DRAWN * count).collect()
    reference = choose_pivots([r[0] for r in drawn], count)
    nearest = min(nearest, max(1, len(reference)))
    shared = min(shared, nearest)

    @F.pandas_udf("array<int>")
    def neighbours(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            near = unit(padded(list(series), reference.shape[1])) @ reference.T if len(series) else np.zeros((0, 1))
            yield pd.Series(list(np.argsort(-near, axis=1, kind="stable")[:, :nearest].astype(np.int32)))

    described = stored(distinct.withColumn("order", neighbours("__v")), "embed-described")
    # One row per pivot: how many vectors name it. Rank 0 is the rarest.
    named = described.select(F.explode("order").alias("p")).groupBy("p").count().collect()
    ranked = {r[0]: i for i, r in enumerate(sorted(named, key=lambda r: (r[1], r[0])))}
    rank = F.array(*[F.lit(ranked.get(p, -1)) for p in range(max(1, len(reference)))])
    described = described.withColumn("pivots", F.array_sort(F.transform("order", lambda p: F.get(rank, p)))).drop("order")

    posted = described.select("node", F.explode(F.slice("pivots", 1, nearest - shared + 1)).alias("list"), F.size("__v").alias("width"))
    lists = posted.groupBy("list", "width").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    entries = (
        described.withColumn("width", F.size("__v"))
        .withColumn("list", F.explode(F.slice("pivots", 1, nearest - shared + 1)))
        .join(lists, ["list", "width"])
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "list", "width", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own",
            "node", "copies", "pivots", "__v",
        )
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", kind="stable")
        here, low, high = int(group["list"].iloc[0]), int(group["low"].iloc[0]), int(group["high"].iloc[0])
        all_v = unit(np.stack(group["__v"].to_numpy()))
        all_p = np.stack(group["pivots"].to_numpy())
        own = group["own"].to_numpy()
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        pairs = linked_pairs(all_v[left], all_v[right], all_p[left], all_p[right], here, shared, threshold)
        pairs = np.stack((left[pairs[:, 0]], right[pairs[:, 1]]), axis=1)
        if low == high:
            pairs = pairs[pairs[:, 0] < pairs[:, 1]]
        copies, nodes = group["copies"].to_numpy(), group["node"].to_numpy()
        n = np.bincount(pairs[:, 0], copies[pairs[:, 1]], len(group)) + np.bincount(pairs[:, 1], copies[pairs[:, 0]], len(group))
        root = nodes[roots_of(pairs, len(group))]
        some = n > 0
        return pd.DataFrame({"node": nodes[some], "links": n[some].astype(np.int64), "root": root[some]})

    found = entries.groupBy("list", "width", "low", "high").applyInPandas(compare, "node bigint, links bigint, root bigint")
    found = stored(found, "embed-links")
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "embed-components")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    entry = (
        distinct.join(linked, "node", "left")
        .join(roots.withColumnRenamed("root", "top"), "node", "left")
        .withColumn("top", F.coalesce("top", "node"))
    )
    least = entry.groupBy("top").agg(F.min("least").alias("component_id"))
    entry = entry.join(least, "top").select(
        F.struct("__v").alias("__k"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    placed = rows.where(v.isNotNull()).withColumn("__k", F.struct("__v")).join(entry, "__k")
    placed = placed.select("__id", "n_links", "component_id").unionByName(
        rows.where(v.isNull()).select("__id", F.lit(0).cast("bigint").alias("n_links"), F.col("__id").alias("component_id"))
    )
    return placed.select(
        F.col("__id").alias(key), "n_links", "component_id", F.col("__id").eqNullSafe(F.col("component_id")).alias("kept")
    )
