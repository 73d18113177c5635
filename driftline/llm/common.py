"""Steps that several corpus operators share: scratch tables, seeded order, components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.session import scratch_path

# White space of the word and normalisation rules: space and the five ASCII control blanks.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared checkpoint folder and read again.

    What was computed survives lost executors and is not computed twice.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Words separated by ASCII white space; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; null for a null key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus))


def seeded_order(seed: int, key: Column, text: Column) -> Column:
    """60 seeded bits per row, the same in every run: of the key and, where keys repeat or are null, the text."""
    name = F.concat_ws(
        ":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    )
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("bigint")


def running_before(
    rows: DataFrame,
    group: str,
    value: str,
    order: str,
    ties: Sequence[str],
    name: str,
    totals: DataFrame | None = None,
    shard_bits: int = 12,
) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the same group that come earlier by ``order``.

    ``order`` holds 60 evenly spread bits (``seeded_order``). Its leading bits cut a group into
    shards; sums per shard are carried forward, and rows are sorted inside a shard only, so a group
    of any size is spread over many tasks. The sums are taken from ``totals``, a stored table with
    the same group, value and order (``rows`` itself if not given).
    """

    def sharded(df: DataFrame) -> DataFrame:
        return df.withColumns({"__g": F.struct(F.col(f"`{group}`")), "__shard": F.shiftright(F.col(order), 60 - shard_bits)})

    totals, rows = sharded(rows if totals is None else totals), sharded(rows)
    earlier = W.partitionBy("__g").orderBy("__shard").rowsBetween(W.unboundedPreceding, -1)
    cells = (
        totals.groupBy("__g", "__shard")
        .agg(F.sum(value).alias("__cell"))
        .select("__g", "__shard", F.coalesce(F.sum("__cell").over(earlier), F.lit(0)).alias("__carried"))
    )
    inside = W.partitionBy("__g", "__shard").orderBy(order, *ties).rowsBetween(W.unboundedPreceding, -1)
    return (
        rows.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(cells, ["__g", "__shard"])
        .withColumn(name, (F.col("__carried") + F.col("__inside")).cast("bigint"))
        .drop("__g", "__shard", "__cell", "__carried", "__inside")
    )


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``: nodes that links connect have one root.

    Each round sends every node to the neighbour that is first by a hash of that round, follows
    that twice, and keeps the links between the nodes that are left. Hashed order shortens chains
    by a constant share per round, whatever the ids look like. Minima are aggregated before the
    shuffle, so a node with very many links costs one row per task. Every round is stored.
    """
    links = stored(edges.select("a", "b").where("a != b").distinct(), name)
    labels = stored(
        links.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")), name
    )
    turn = 0
    while not links.isEmpty():
        turn += 1

        def first(c: str, salt: int = turn) -> Column:
            return F.struct(F.xxhash64(F.lit(salt), F.col(c)).alias("h"), F.col(c).alias("n"))

        both = links.select("a", "b").union(links.select("b", "a")).toDF("a", "b")
        step = stored(
            both.groupBy("a").agg(F.min(first("b")).alias("m")).select(F.col("a").alias("node"), F.least(first("a"), F.col("m"))["n"].alias("to")),
            name,
        )
        again = step.select(F.col("node").alias("to"), F.col("to").alias("to2"))
        hop = stored(step.join(again, "to").select("node", F.col("to2").alias("to")), name)
        links = stored(
            links.join(hop.toDF("a", "ra"), "a")
            .join(hop.toDF("b", "rb"), "b")
            .where("ra != rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct(),
            name,
        )
        labels = stored(
            labels.join(hop.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), name
        )
    return labels


def has_repeats(df: DataFrame, key: str) -> bool:
    """Whether two rows share a key (null included)."""
    return not df.groupBy(F.col(f"`{key}`")).count().where("count > 1").isEmpty()


