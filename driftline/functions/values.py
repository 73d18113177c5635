"""Conversions between field types, with the JSON typing rules of the documents."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: text that parses as a finite decimal or exponent number.
NUMBER_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)
NESTED = (T.StructType, T.ArrayType, T.MapType, T.VariantType)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Use ``value`` several times in ``body`` but compute it once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quote_json(text: Column) -> Column:
    """JSON string token of a text."""
    plain = ~text.rlike(r'["\\\x00-\x1f]')
    escaped = let(F.to_json(F.array(text)), lambda a: F.substring(a, F.lit(2), F.length(a) - 2))
    return F.when(plain, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(escaped)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def double_text(c: Column) -> Column:
    """Shortest JSON text of a double: plain digits from 1e-5 up to 1e16, exponent outside."""
    plain = F.regexp_replace(c.cast("decimal(38,18)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    spark_text = c.cast("string")
    exponent = F.lower(F.regexp_replace(spark_text, r"\.0E", "E"))
    magnitude = F.abs(c)
    return (
        F.when(~spark_text.contains("E"), spark_text)
        .when((magnitude >= 1e-5) & (magnitude < 1e16), plain)
        .otherwise(exponent)
    )


def json_text(c: Column, dtype: T.DataType) -> Column:
    """Unquoted JSON text of a value; a null prints as ``null``."""
    if isinstance(dtype, T.StringType):
        text = c
    elif isinstance(dtype, FRACTIONAL):
        text = double_text(c)
    elif isinstance(dtype, NESTED):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("null"))


def composite_text(c: Column, dtype: T.DataType) -> Column:
    """Text used inside composites: like :func:`json_text`, but a null is empty."""
    return F.when(c.isNull(), F.lit("")).otherwise(json_text(c, dtype))


def number_from_text(c: Column) -> Column:
    """Double parsed from text; null for anything that is not a finite number."""
    parsed = F.when(c.rlike(NUMBER_TEXT), c.try_cast("double"))
    return F.when(F.abs(parsed) < float("inf"), parsed)


def to_number(c: Column, dtype: T.DataType) -> tuple[Column, Column]:
    """Number and error text (null when the conversion worked)."""
    if is_numeric(dtype):
        return c, F.when(c.isNull(), F.lit("This value is no number"))
    if isinstance(dtype, T.StringType):
        number = number_from_text(c)
        error = F.when(c.isNull(), F.lit("This value is no number")).when(
            number.isNull(), F.concat(F.lit("'"), c, F.lit("' is no number"))
        )
        return number, error
    return F.lit(None).cast("double"), F.lit("This value is no number")


def to_boolean(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        flag = c
    elif isinstance(dtype, T.StringType):
        flag = (F.lower(c) == "true") | (c == "1")
    elif isinstance(dtype, INTEGRAL):
        flag = c != 0
    else:
        flag = F.lit(False)
    return F.coalesce(flag, F.lit(False))


def to_array(c: Column, dtype: T.DataType) -> Column:
    return c if isinstance(dtype, T.ArrayType) else F.array(c)


def literal(value: Any) -> Column:
    """Literal of a JSON value; lists become arrays and objects become structs."""
    if isinstance(value, dict):
        return F.struct(*[literal(v).alias(k) for k, v in value.items()])
    if isinstance(value, (list, tuple)):
        return F.array(*[literal(v) for v in value])
    return F.lit(value)


def json_equals(c: Column, dtype: T.DataType, value: Any) -> Column | None:
    """Equality with a JSON literal in the column's own type.

    Returns None when the literal belongs to another type family, which never matches.
    """
    if value is None:
        return c.isNull()
    if isinstance(value, bool):
        return c == F.lit(value) if isinstance(dtype, T.BooleanType) else None
    if isinstance(value, (int, float)):
        return c == F.lit(value) if is_numeric(dtype) else None
    if isinstance(value, str):
        if isinstance(dtype, T.StringType):
            return c == F.lit(value)
        if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return c.cast("string") == F.lit(value)
        return None
    if isinstance(value, (list, tuple)) and isinstance(dtype, T.ArrayType):
        if not value:
            return F.size(c) == 0
        return F.to_json(c) == F.to_json(F.array(*[literal(v) for v in value]).cast(dtype))
    if isinstance(value, dict) and isinstance(dtype, T.StructType):
        if set(value) != set(dtype.fieldNames()):
            return None
        tests = [json_equals(c.getField(f.name), f.dataType, value[f.name]) for f in dtype.fields]
        if any(t is None for t in tests):
            return None
        result = c.isNotNull()
        for test in tests:
            result = result & test
        return result
    return None


def walk_path(c: Column, dtype: T.DataType, path: str) -> tuple[Column, T.DataType] | None:
    """Value at a dotted path through structs, maps, arrays and variants.

    Returns None when the schema proves that the path does not exist.
    """
    for part in path.split("."):
        if isinstance(dtype, T.StructType):
            if part not in dtype.fieldNames():
                return None
            c, dtype = c.getField(part), dtype[part].dataType
        elif isinstance(dtype, T.ArrayType):
            if not part.isdigit():
                return None
            c, dtype = F.get(c, F.lit(int(part))), dtype.elementType
        elif isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
            c, dtype = F.try_element_at(c, F.lit(part)), dtype.valueType
        elif isinstance(dtype, T.VariantType):
            steps = [f"$['{part}']"] + ([f"$[{int(part)}]"] if part.isdigit() else [])
            c = F.coalesce(*[F.try_variant_get(c, step, "variant") for step in steps])
        else:
            return None
    return c, dtype
