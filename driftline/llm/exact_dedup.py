"""Exact dedup: rows group by a 128-bit content hash, and bytes are compared inside groups.

Texts are equal when they are identical after the characters of ``[\\x20\\x09-\\x0D]`` are deleted.
The first pass groups by (hash, normalised text): Spark compares whole keys byte by byte, and
copies collapse in each task before the shuffle, so a group with a third of all rows is no larger
than any other. From there on only hashes travel. A hash that covers two different texts is
noticed, and its rows are told apart by the text itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.llm.common import has_repeats, stored

WIDE = "decimal(38,0)"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\u000b\f\r", "")


def digest128(sha256: Column) -> Column:
    """The first 128 bits of the SHA-256, as 32 hex digits."""
    return F.substring(sha256, 1, 32)


def _rank(n: Column, key: Column) -> Column:
    """One number that is larger for more code points, then for a smaller key; null keys come last.

    A number, unlike a struct, keeps the aggregate on hashes: no sort by whole texts.
    """
    keyed = F.coalesce(F.lit("10000000000000000000").cast(WIDE) - key.cast(WIDE), F.lit(0).cast(WIDE))
    return (n.cast("decimal(10,0)") * F.lit("100000000000000000000").cast("decimal(21,0)") + keyed.cast("decimal(21,0)")).cast(WIDE)


def _key_of(rank: Column) -> Column:
    rest = F.pmod(rank, F.lit("100000000000000000000").cast(WIDE))
    return F.when(rest > 0, (F.lit("10000000000000000000").cast(WIDE) - rest).cast("bigint"))


def mark(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    digest: Callable[[Column], Column] = digest128,
    whole_rows: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: key, ``keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the most code points in its original text stays, then the one with
    the smallest key. ``group_size`` counts rows. Null texts are empty texts, and all empty texts
    are one group. A null key loses every tie; ``keep_id`` is null where a group has null keys
    only. Of rows that repeat the staying key, one is kept. An empty table gives no rows. Other
    columns are ignored; ``whole_rows`` adds all columns of ``docs`` as the struct ``row``.

    ``digest`` shortens the SHA-256 to the group hash (a test passes a weak one).
    """
    kept_columns = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole_rows else []

    def rows(*more: Column) -> DataFrame:
        read = docs.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{text}`").alias("__t"), *more)
        read = read.withColumn("__norm", normalised(F.col("__t")))
        read = read.withColumn("__sha", F.sha2(F.col("__norm").cast("binary"), 256))
        return read.withColumns({"__n": F.char_length(F.coalesce("__t", F.lit(""))), "__h": digest(F.col("__sha"))}).drop("__t")

    texts = (
        rows()
        .withColumn("__r", _rank(F.col("__n"), F.col("__id")))
        .groupBy("__h", "__norm")
        .agg(F.max("__r").alias("__win"), F.count(F.lit(1)).alias("group_size"))
    )
    groups = stored(
        texts.groupBy("__h").agg(
            F.max("__win").alias("__win"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("__texts")
        ),
        "exact-groups",
    )
    clashes = groups.where("__texts > 1").select("__h")
    single = groups.where("__texts = 1").drop("__texts")
    if clashes.isEmpty():
        joined = rows(*kept_columns).join(single, "__h")
    else:
        shared = stored(texts.join(clashes, "__h"), "exact-clashes")
        apart = rows(*kept_columns).join(shared, ["__h", "__norm"])
        joined = rows(*kept_columns).join(single, "__h").unionByName(apart)
    joined = joined.withColumn("keep_id", _key_of(F.col("__win")))
    stays = _rank(F.col("__n"), F.col("__id")) == F.col("__win")
    if has_repeats(docs, key):
        one = W.partitionBy("__h", "__sha", "__id", "__stays").orderBy("__n")
        joined = joined.withColumn("__stays", stays).withColumn("kept", F.col("__stays") & (F.row_number().over(one) == 1))
    else:
        joined = joined.withColumn("kept", stays)
    return joined.select(
        F.col("__id").alias(key), "keep_id", "group_size", "kept", F.col("__sha").alias("text_sha256"),
        *(["row"] if whole_rows else []),
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``mark`` keeps, with the columns of ``docs``."""
    return mark(docs, key, text, whole_rows=True).where("kept").select("row.*")
