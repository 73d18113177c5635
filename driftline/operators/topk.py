"""First and last rows per key, global cuts and samples.

``row_number() <= n`` is cut before the shuffle (each task keeps its own best n per key), so a
hot key sends n rows per task and not its whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.session import scratch_path


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of every key in ``order``."""
    spec = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(spec)).where(F.col("__rank") <= n).drop("__rank")


# Up to this many rows per key Spark cuts every task's share before the shuffle; beyond it the cut
# goes by counts. Both keep the same rows.
EARLY_CUT = 1000


def newest_per_key(df: DataFrame, keys: Sequence[str], n: int, created: str, tiebreak: str) -> DataFrame:
    if n > EARLY_CUT:
        return cut_by_time(df, keys, n, created, tiebreak)
    return first_per_key(df, keys, [F.col(created).desc(), F.col(tiebreak).desc()], n)


def oldest_per_key(df: DataFrame, keys: Sequence[str], n: int, created: str, tiebreak: str) -> DataFrame:
    if n > EARLY_CUT:
        return cut_by_time(df, keys, n, created, tiebreak, newest=False)
    return first_per_key(df, keys, [F.col(created).asc(), F.col(tiebreak).asc()], n)


def keep_newest(df: DataFrame, n: int, created: str, tiebreak: str, unit: str = "minute") -> DataFrame:
    """The newest ``n`` rows overall, for any ``n``."""
    return cut_by_time(df, [], n, created, tiebreak, unit=unit)


# Rows of one key that a window may rank in one task.
RANKED_ROWS = 200_000


def _stored(df: DataFrame, name: str) -> DataFrame:
    """A small table written below the scratch folder: what it was made from is read once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ranked_by_range(rows: DataFrame, order: Column) -> DataFrame:
    """``rows`` with ``__rank`` within ``__key`` by ``order``, sorted by range in as many tasks as it takes."""
    # Number of the sorted partition in the upper bits, of the row within it below.
    numbered = _stored(rows.orderBy("__key", order).withColumn("__id", F.monotonically_increasing_id()), "cut-rows")
    numbered = numbered.withColumn("__task", F.shiftright("__id", 33))
    tasks = numbered.groupBy("__key", "__task").agg(F.count(F.lit(1)).alias("__rows"), F.min("__id").alias("__first"))
    earlier = W.partitionBy("__key").orderBy("__task").rowsBetween(W.unboundedPreceding, -1)
    tasks = tasks.select("__key", "__task", "__first", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__start"))
    rank = F.col("__start") + F.col("__id") - F.col("__first") + 1
    return numbered.join(tasks, ["__key", "__task"]).withColumn("__rank", rank).drop("__id", "__task", "__first", "__start")


def cut_by_time(
    df: DataFrame, keys: Sequence[str], n: int, created: str, tiebreak: str, newest: bool = True, unit: str = "minute"
) -> DataFrame:
    """The newest (or oldest) ``n`` rows per key by time, then ``tiebreak``, for any ``n`` and any number of rows per key.

    Counts per time unit tell in which unit the cut falls, and how many rows it has. Their times and
    tiebreaks are ranked in a window where they are few (``RANKED_ROWS`` of a key). Beyond that Spark's range
    partitioning sorts them, and numbers of rows per task and key give the rank: a time that a third of
    all rows share is sorted by its tiebreak in many tasks. Rows without a time are the oldest.
    """
    if n <= 0:
        return df.limit(0)
    spark = df.sparkSession
    # Structs are never null themselves, so a missing time compares and joins like any other.
    unit_of = F.struct(F.date_trunc(unit, created).alias("t"))
    place = F.struct(F.col(created).alias("t"), F.col(tiebreak).alias("b"))
    # Without keys all rows have one, made from a column: joins by a constant would compare every pair of rows.
    parts = [F.col(f"`{k}`") for k in keys] or [F.pmod(F.hash(tiebreak), F.lit(1)).alias("all")]
    rows = df.withColumns({"__key": F.struct(*parts), "__place": place})
    side = (lambda c: F.col(c).desc()) if newest else (lambda c: F.col(c).asc())
    before = lambda column: W.partitionBy("__key").orderBy(side(column)).rowsBetween(W.unboundedPreceding, -1)

    units = rows.groupBy("__key", unit_of.alias("__unit")).agg(F.count(F.lit(1)).alias("__count"))
    units = units.withColumn("__left", F.lit(n) - F.coalesce(F.sum("__count").over(before("__unit")), F.lit(0)))
    split = units.where((F.col("__left") > 0) & (F.col("__count") >= F.col("__left"))).select("__key", "__unit", "__left", "__count")
    split = _stored(split, "cut-units")
    narrow = rows.select("__key", unit_of.alias("__unit"), "__place").join(split.drop("__count"), ["__key", "__unit"]).drop("__unit")
    if (split.agg(F.max("__count")).first()[0] or 0) <= RANKED_ROWS:
        ranked = narrow.withColumn("__rank", F.row_number().over(W.partitionBy("__key").orderBy(side("__place"))))
    else:
        ranked = _ranked_by_range(narrow, side("__place"))
    cut = ranked.where(F.col("__rank") == F.col("__left")).select("__key", F.col("__place").alias("__cut"), F.col("__left").alias("__last"))
    # Rows that equal the cut in time and tiebreak: how many of them there are and how many stay.
    same = ranked.join(cut, "__key").where(F.col("__place") == F.col("__cut"))
    cut = same.groupBy("__key", "__cut").agg(
        F.count(F.lit(1)).alias("__equal"), (F.max("__last") - F.min("__rank") + 1).alias("__stay")
    )
    cut = _stored(cut, "cuts")
    joined = rows.join(cut, "__key", "left")
    beyond = F.col("__place") > F.col("__cut") if newest else F.col("__place") < F.col("__cut")
    at_cut = F.col("__place") == F.col("__cut")
    if cut.where("__equal > __stay").isEmpty():
        return joined.where(F.col("__cut").isNull() | beyond | at_cut).select(*df.columns)
    whole = joined.where(F.col("__cut").isNull() | beyond)
    ties = joined.where(at_cut).withColumn("__rank", F.row_number().over(W.partitionBy("__key").orderBy("__place")))
    return whole.select(*df.columns).unionByName(ties.where(F.col("__rank") <= F.col("__stay")).select(*df.columns))


def sample_rows(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """``k`` rows chosen by a seeded hash of their key: the same rows on every run."""
    score = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return df.orderBy(score, key).limit(k)
