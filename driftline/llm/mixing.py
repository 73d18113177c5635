"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

Every source gets a share of the budget by its weight. A source whose share exceeds
``max_epochs`` times its size is clamped there, and what it leaves is shared out again by weight
among the rest, until no source is above its cap. A document is then repeated as often as its
source's target asks: whole repetitions for every document, and one more for documents in seeded
order until the rest of the target is used up; the last of them is taken in part.

Only DataFrame operations. The driver sees two numbers per round of water-filling.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.llm.common import running_before, seeded_order, stored, word_count

# Rows of a partition are numbered in the low bits of this function's values.
_PART_BITS = 33


def ranked(sources: DataFrame, name: str) -> DataFrame:
    """``sources`` with its rows numbered from 0 by ``name`` in code-point order, null last, for any number of rows."""
    ordered = sources.orderBy(F.col(name).asc_nulls_last())
    placed = stored(ordered.withColumn("__at", F.monotonically_increasing_id()), "mix-sources")
    placed = placed.withColumns(
        {"__part": F.shiftright("__at", _PART_BITS), "__row": F.col("__at").bitwiseAND(F.lit((1 << _PART_BITS) - 1))}
    )
    # One row per partition of the sort.
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    parts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))
    parts = parts.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    return placed.join(parts, "__part").withColumn("rank", F.col("__before") + F.col("__row")).drop(
        "__at", "__part", "__row", "__before"
    )


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """Adds ``target`` to ``sources(size, weight)``: ``share`` of all sizes by weight, at most ``max_epochs`` sizes each."""
    cap = F.col("size") * F.lit(float(max_epochs))
    budget = share * (sources.agg(F.sum("size")).first()[0] or 0)
    clamped, left, weight = -1, budget, 0.0
    level = None
    while True:
        over = F.lit(False) if level is None else cap * F.lit(float(weight)) <= F.col("weight") * F.lit(float(left))
        n, taken, free = sources.agg(
            F.count(F.when(over, 1)),
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight").cast("double"))), F.lit(0.0)),
        ).first()
        if n == clamped:
            break
        clamped, left, weight, level = n, budget - taken, free, True
        if free == 0:
            return sources.withColumn("target", cap)
    filled = F.lit(float(left)) * F.col("weight") / F.lit(float(weight)) if weight else F.lit(0.0)
    return sources.withColumn("target", F.when(over, cap).otherwise(filled))


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 11,
    whole_rows: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: key, ``size, source_size, target, taken``.

    ``size`` counts words (null text: 0). Sources, in code-point order with null as the last one,
    take ``weights`` in turn. ``target`` is the source's, ``taken`` the words the mix takes of the
    row, repetitions counted. The words taken of a source add up to its target, rounded, and no row
    exceeds ``max_epochs`` (rounded up) times its size. The order within a source depends on seed,
    key and text only, so reruns agree; rows equal in both are interchangeable. Rows without words
    take 0. An empty table gives no rows. Other columns are ignored; ``whole_rows`` adds all
    columns of ``docs`` as the struct ``row``.
    """

    def rows(*more: Column) -> DataFrame:
        return docs.select(
            F.col(f"`{key}`").alias("__id"), F.col(f"`{source}`").alias("__source"), word_count(F.col(f"`{text}`")).alias("size"),
            seeded_order(seed, F.col(f"`{key}`"), F.col(f"`{text}`")).alias("__order"), *more,
        )

    small = stored(rows(), "mix-rows")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    sources = ranked(small.groupBy("__source").agg(F.sum("size").alias("size")), "__source")
    sources = sources.withColumn("weight", F.get(turn, F.pmod("rank", F.lit(len(weights))).cast("int")))
    targets = water_fill(stored(sources, "mix-weights"), share, max_epochs).select(
        F.struct("__source").alias("__s"), F.col("size").alias("source_size"), "target"
    )
    full = rows(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")) if whole_rows else small
    placed = running_before(full, "__source", "size", "__order", ["__id", "size"], "before", small)
    placed = placed.withColumn("__s", F.struct("__source")).join(targets, "__s")
    placed = placed.withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    )
    rest = F.round("target").cast("bigint") - F.col("whole") * F.col("source_size")
    part = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), rest - F.col("before")))
    return placed.select(
        F.col("__id").alias(key), "size", "source_size", "target", (F.col("whole") * F.col("size") + part).alias("taken"),
        *(["row"] if whole_rows else []),
    )


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: every row, whole, as often as ``mix`` takes it.

    The one row per source that ``mix`` takes in part is taken whole or not at all, whichever leaves
    the source nearer its target (whole if both are as near), so texts are never cut. Rows the mix does not
    take are gone; repetitions carry the same key.
    """
    marked = mix(docs, key, text, whole_rows=True, **options).where("taken > 0")
    copies = F.expr("(2 * taken + size) div (2 * size)").cast("int")
    each = marked.select("row", F.explode(F.array_repeat(F.lit(0), copies)))
    return each.select("row.*")
