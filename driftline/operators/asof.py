"""Change rows joined with the newest relation version before them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.pgtypes import decode
from driftline.operators.ordered import LOG_SEGMENT, log_chunk, running


# A version table up to this size travels to every task, as one sorted array per key.
INDEX_ROWS, INDEX_BYTES = 100_000, 8 << 20


def asof_join(
    changes: DataFrame,
    versions: DataFrame,
    key: str,
    position: str,
    payload: Sequence[str],
    segment: int = LOG_SEGMENT,
    span: int | None = None,
    index_rows: int = INDEX_ROWS,
) -> DataFrame:
    """``changes`` with ``payload`` of the last version at or before their position (null if none).

    The versions are counted first. Up to ``index_rows`` of them (and ``INDEX_BYTES`` in all) become
    one sorted array per key that is broadcast, and each change finds its version by binary search,
    where it is. More of them make one log with the changes, in which the newest payload is carried
    forward: nothing is broadcast and no pair of rows is compared, so neither a hot key nor many versions matter.
    """
    most = _most_per_key(versions, key, position, payload, index_rows)
    if most is not None:
        return _by_index(changes, versions, key, position, payload, most)
    return _by_carry(changes, versions, key, position, payload, segment, span)


def _most_per_key(versions: DataFrame, key: str, position: str, payload: Sequence[str], index_rows: int) -> int | None:
    """Versions of the key that has most, if all of them are few enough to broadcast."""
    rows = versions.select(F.struct(key).alias("k"), F.octet_length(F.to_json(F.struct(key, position, *payload))).alias("b"))
    # No more than one row too many is looked at.
    per_key = rows.limit(index_rows + 1).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b"))
    size = per_key.agg(F.sum("n").alias("rows"), F.max("n").alias("most"), F.sum("b").alias("bytes")).first()
    if (size["rows"] or 0) > index_rows or (size["bytes"] or 0) > INDEX_BYTES:
        return None
    return size["most"] or 0


def _by_index(changes: DataFrame, versions: DataFrame, key: str, position: str, payload: Sequence[str], most: int) -> DataFrame:
    entry = F.struct(F.col(position).alias("at"), F.struct(*payload).alias("payload"))
    index = versions.groupBy(F.col(key).alias("__key")).agg(F.sort_array(F.collect_list(entry)).alias("__versions"))
    rows = changes.join(F.broadcast(index), F.col(f"`{key}`").eqNullSafe(F.col("__key")), "left")
    held, at = F.col("__versions"), F.col(position)

    def reached(i: Column) -> Column:
        """Whether entry ``i`` exists and is at or before the change; entries without a position come first."""
        found = F.get(held, i)
        return F.when(found.isNull(), F.lit(False)).otherwise(found["at"].isNull() | F.coalesce(found["at"] <= at, F.lit(False)))

    steps = [F.lit(1 << b) for b in reversed(range(most.bit_length()))] or [F.lit(1)]
    # Entries at or before the change: the largest number that halving steps reach.
    number = F.aggregate(F.array(*steps), F.lit(0), lambda n, step: F.when(reached(n + step - 1), n + step).otherwise(n))
    rows = rows.withColumn("__found", F.get(held, number - 1)["payload"])
    return rows.select(*[F.col(f"`{c}`") for c in changes.columns], *[F.col("__found").getField(p).alias(p) for p in payload])


def _by_carry(
    changes: DataFrame, versions: DataFrame, key: str, position: str, payload: Sequence[str], segment: int, span: int | None
) -> DataFrame:
    fields = [F.col(p) for p in payload]
    left = changes.withColumns({"__rank": F.lit(1), "__payload": F.lit(None).cast(_type_of(versions, payload))})
    right = versions.select(
        key, position, F.lit(0).alias("__rank"), F.struct(*fields).alias("__payload")
    )
    both = left.unionByName(right, allowMissingColumns=True)
    carried = running(
        both,
        [key],
        [position, "__rank"],
        log_chunk(F.col(position), segment),
        {"__found": ("last", F.col("__payload"))},
        span,
    )
    rows = carried.where(F.col("__rank") == 1)
    return rows.select(
        *[F.col(f"`{c}`") for c in changes.columns], *[F.col("__found").getField(p).alias(p) for p in payload]
    )


def _type_of(df: DataFrame, columns: Sequence[str]):
    return df.select(F.struct(*columns).alias("s")).schema["s"].dataType


def name_values(columns: Column, values: Column) -> Column:
    """``array<struct<name, type_oid, text>>`` of a text tuple; values beyond the columns are left out."""
    named = F.zip_with(
        F.slice(columns, F.lit(1), F.greatest(F.lit(0), F.least(F.size(columns), F.size(values)))),
        F.slice(values, F.lit(1), F.greatest(F.lit(0), F.least(F.size(columns), F.size(values)))),
        lambda c, v: F.struct(
            c.getField("name").alias("name"), c.getField("type_id").alias("type_oid"), v.alias("text")
        ),
    )
    return named


def decode_named(named: Column, wanted: Mapping[str, int]) -> dict[str, Column]:
    """Typed columns by name from :func:`name_values`, decoded with the given type ids.

    A field whose relation version declares another type id still goes through ``wanted``: the
    output schema is fixed, the version only decides which position holds the field.
    """

    def pick(name: str) -> Column:
        hits = F.filter(named, lambda e: e.getField("name") == name)
        return F.get(hits, F.lit(0)).getField("text")

    return {name: decode(pick(name), oid) for name, oid in wanted.items()}
