"""Estimated in-memory size of a document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes per JSON kind; every object key costs its text plus the string overhead.
SCALAR_BYTES = 8
NUMBER_BYTES = 16
CONTAINER_BYTES = 24


# The parts of a compact JSON text that cost something.
_JSON_PART = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[\[{]|true|false|null|-?[0-9][0-9.eE+-]*+'


def json_size(text: Column) -> Column:
    """Size of a JSON text by the same rule. Every value and key costs on its own, so nesting does not matter."""

    def part(total: Column, token: Column) -> Column:
        plain = F.octet_length(token) - 2
        escaped = F.octet_length(F.try_variant_get(F.try_parse_json(token), "$", "string"))
        string = F.when(F.contains(token, F.lit("\\")), escaped).otherwise(plain) + CONTAINER_BYTES
        size = (
            F.when(token.startswith('"'), string)
            .when(token.isin("[", "{"), CONTAINER_BYTES)
            .when(token.isin("true", "false", "null"), SCALAR_BYTES)
            .otherwise(NUMBER_BYTES)
        )
        return total + size.cast("bigint")

    return F.aggregate(F.regexp_extract_all(text, F.lit(_JSON_PART), F.lit(0)), F.lit(0).cast("bigint"), part)


def value_size(c: Column, dtype: T.DataType) -> Column:
    null_size = F.lit(SCALAR_BYTES).cast("bigint")
    if isinstance(dtype, T.NumericType):
        size: Column = F.lit(NUMBER_BYTES).cast("bigint")
    elif isinstance(dtype, (T.BooleanType, T.NullType)):
        return null_size
    elif isinstance(dtype, T.ArrayType):
        if isinstance(dtype.elementType, T.NumericType) and not dtype.containsNull:
            size = F.lit(CONTAINER_BYTES) + F.size(c).cast("bigint") * NUMBER_BYTES
        else:
            size = F.aggregate(
                c,
                F.lit(CONTAINER_BYTES).cast("bigint"),
                lambda acc, e: acc + value_size(e, dtype.elementType),
            )
    elif isinstance(dtype, T.StructType):
        size = object_size({f.name: (c.getField(f.name), f.dataType) for f in dtype.fields})
    elif isinstance(dtype, T.MapType):
        size = F.aggregate(
            F.map_entries(c),
            F.lit(CONTAINER_BYTES).cast("bigint"),
            lambda acc, e: acc
            + CONTAINER_BYTES
            + F.octet_length(e.getField("key").cast("string"))
            + value_size(e.getField("value"), dtype.valueType),
        )
    elif isinstance(dtype, T.VariantType):
        size = json_size(F.to_json(c))
    else:
        size = F.octet_length(c.cast("string")).cast("bigint") + CONTAINER_BYTES
    return F.when(c.isNull(), null_size).otherwise(size)


def object_size(fields: dict[str, tuple[Column, T.DataType]]) -> Column:
    keys = CONTAINER_BYTES + sum(CONTAINER_BYTES + len(name.encode()) for name in fields)
    return reduce(lambda a, b: a + b, [value_size(c, t) for c, t in fields.values()], F.lit(keys).cast("bigint"))


def document_size(schema: T.StructType) -> Column:
    """Size of the whole row, read as one JSON object."""
    return object_size({f.name: (F.col(f"`{f.name}`"), f.dataType) for f in schema.fields})
