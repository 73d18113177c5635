"""Logs whose tables change while they run: columns added, dropped and widened.

Every change is decoded with the columns its relation version has, into one schema that holds all of
them: a column is null in rows of versions without it, and has a type that holds the values of all
its versions. Tables written under an earlier schema are read under the later one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.pgtypes import OIDS, type_of_oid
from driftline.operators.asof import asof_join, decode_named, name_values
from driftline.sources.keyed_table import KeyedTable

_WHOLE = ("int2", "int4", "int8")


def wider(a: int, b: int) -> int:
    """The type id that holds the values of both: the larger number type where nothing is lost, else text."""
    if a == b:
        return a
    first, second = type_of_oid(a), type_of_oid(b)
    names = {first[0], second[0]}
    if first[1] or second[1]:
        return OIDS["text"]
    if names <= set(_WHOLE):
        return OIDS[max(names, key=_WHOLE.index)]
    if names <= {"int2", "int4", "float4", "float8"}:
        return OIDS["float8"]
    if names <= {*_WHOLE, "numeric"}:
        return OIDS["numeric"]
    return OIDS["text"]


def merged_columns(versions: DataFrame, position: str, columns: str = "columns") -> dict[str, int]:
    """Name and type id of every column of all versions, in the order they came up.

    ``columns`` is an array of structs with ``name`` and ``type_id``. What is collected is a row per column and type.
    """
    each = versions.select(F.col(position).alias("at"), F.posexplode(columns).alias("place", "c"))
    found = each.groupBy("c.name", "c.type_id").agg(F.min(F.struct("at", "place")).alias("first")).collect()
    kinds: dict[str, list[int]] = {}
    for row in sorted(found, key=lambda r: (r["first"]["at"], r["first"]["place"])):
        kinds.setdefault(row["name"], []).append(row["type_id"])
    return {name: reduce(wider, types) for name, types in kinds.items()}


def evolving_rows(
    changes: DataFrame, versions: DataFrame, key: str, position: str, values: str = "tuple", columns: str = "columns"
) -> DataFrame:
    """``changes`` with the columns of all versions instead of their text tuple ``values``.

    A change is read with the newest version at or before its position; without one all columns are null.
    """
    wanted = merged_columns(versions, position, columns)
    joined = asof_join(changes, versions, key, position, [columns])
    named = joined.withColumn("__named", name_values(F.col(columns), F.col(values)))
    typed = decode_named(F.col("__named"), wanted)
    return named.select(*[F.col(f"`{c}`") for c in changes.columns if c != values], *[c.alias(n) for n, c in typed.items()])


def row_schema(rows: DataFrame, names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, rows.schema[n].dataType) for n in names])


# What the files of a table may hold where a later schema asks for the type.
_READ_AS = {
    T.ByteType: (T.ShortType, T.IntegerType, T.LongType),
    T.ShortType: (T.IntegerType, T.LongType),
    T.IntegerType: (T.LongType,),
    T.FloatType: (T.DoubleType,),
}


def evolved(table: KeyedTable, schema: T.StructType) -> KeyedTable:
    """``table`` under a later schema.

    Added columns, dropped ones and larger whole numbers are a matter of reading, so nothing is
    written. Any other change of type folds the table into a new base with the values cast once.
    """
    later = KeyedTable(table.spark, table.path, table.keys, schema, table.unchanged)
    before = {f.name: f.dataType for f in table.schema.fields}
    kept = {f.name: f.dataType for f in schema.fields if f.name in before}
    cast = [n for n, t in kept.items() if t != before[n] and not isinstance(t, _READ_AS.get(type(before[n]), ()))]
    if cast and table.compact() >= 0:
        rows = table.base()
        columns = [(F.col(f"`{f.name}`") if f.name in before else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
        later.write_base(rows.select(*columns), table.version() + 1, table.batch_names())
    return later
