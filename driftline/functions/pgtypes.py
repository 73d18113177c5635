"""Decoding of database text values by declared type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.functions.values import NUMBER_TEXT, double_text, let, quote_json

# Type ids of the database catalogue.
OIDS = {
    "bool": 16,
    "bytea": 17,
    "char": 18,
    "int8": 20,
    "int2": 21,
    "int4": 23,
    "text": 25,
    "oid": 26,
    "json": 114,
    "xml": 142,
    "float4": 700,
    "float8": 701,
    "money": 790,
    "macaddr": 829,
    "inet": 869,
    "date": 1082,
    "time": 1083,
    "timestamp": 1114,
    "timestamptz": 1184,
    "interval": 1186,
    "timetz": 1266,
    "numeric": 1700,
    "uuid": 2950,
    "jsonb": 3802,
}

# Ids of the array types.
ARRAY_OIDS = {
    "json": 199,
    "bool": 1000,
    "bytea": 1001,
    "char": 1002,
    "int2": 1005,
    "int4": 1007,
    "text": 1009,
    "int8": 1016,
    "float4": 1021,
    "float8": 1022,
    "oid": 1028,
    "macaddr": 1040,
    "inet": 1041,
    "timestamp": 1115,
    "date": 1182,
    "time": 1183,
    "timestamptz": 1185,
    "interval": 1187,
    "numeric": 1231,
    "timetz": 1270,
    "uuid": 2951,
    "jsonb": 3807,
}

# Type names as the text log prints them.
LOG_TYPES = {
    "boolean": "bool",
    "smallint": "int2",
    "integer": "int4",
    "bigint": "int8",
    "real": "float4",
    "double precision": "float8",
    "numeric": "numeric",
    "money": "money",
    "json": "json",
    "jsonb": "jsonb",
    "character varying": "text",
    "text": "text",
    "uuid": "uuid",
    "date": "date",
    "timestamp without time zone": "timestamp",
    "timestamp with time zone": "timestamptz",
    "bytea": "bytea",
    "inet": "inet",
}

# Fixed value: one element of an array literal, braces removed.
ARRAY_ELEMENT = r'("[^"\\]*+(?:\\.[^"\\]*+)*+"|[^,]++)'

# Fixed value: text that parses as an integer. Casts are only tried on text of the right shape: a
# cast that fails costs far more than the pattern.
INTEGER_TEXT = r"^[+-]?\d+$"

# 64-bit cents fit.
MONEY = "decimal(20,2)"

# Numbers that NUMERIC holds digit for digit.
NUMERIC = "decimal(38,10)"
_NUMERIC_TEXT = r"^\s*[+-]?0*+\d{0,28}(?:\.\d{0,10}0*)?\s*$"

_INTEGERS = {"int2": "smallint", "int4": "int", "int8": "bigint"}
_OID_NAMES = {oid: name for name, oid in OIDS.items()}
_ARRAY_OID_NAMES = {oid: name for name, oid in ARRAY_OIDS.items()}


def type_of_oid(oid: int) -> tuple[str, bool]:
    """Type name and whether the id is an array type; unknown ids are text."""
    if oid in _ARRAY_OID_NAMES:
        return _ARRAY_OID_NAMES[oid], True
    return _OID_NAMES.get(oid, "text"), False


def money(c: Column) -> Column:
    cleaned = F.replace(F.regexp_replace(c, r"^\$+", ""), F.lit(","), F.lit(""))
    amount = let(cleaned, lambda v: F.when(v.rlike(NUMBER_TEXT), v).try_cast(MONEY))
    return F.coalesce(amount, F.lit(0).cast(MONEY))


def misfit(c: Column, type_name: str) -> Column:
    """Whether a text is a number that its column type would cut (more digits, NaN): keep the text and report it."""
    if type_name != "numeric":
        return F.lit(False)
    # An exponent moves the point: such a text fits when it comes out as the same number.
    same = F.when(c.rlike(NUMBER_TEXT), c).try_cast(NUMERIC).cast("double") == F.when(c.rlike(NUMBER_TEXT), c).try_cast("double")
    fits = c.rlike(_NUMERIC_TEXT) | (F.contains(F.lower(c), F.lit("e")) & F.coalesce(same, F.lit(False)))
    return F.coalesce(c.isNotNull() & ~fits, F.lit(False))


def decode_scalar(c: Column, type_name: str, numeric_type: str = NUMERIC) -> Column:
    """Typed column of a text value; a null text stays null.

    A numeric that its type would cut is null, see :func:`misfit`.
    """
    if type_name == "bool":
        value = c.isin("t", "true")
    elif type_name in _INTEGERS:
        exact = F.when(c.rlike(INTEGER_TEXT), c).try_cast(_INTEGERS[type_name])
        value = F.coalesce(exact, F.lit(0).cast(_INTEGERS[type_name]))
    elif type_name in ("float4", "float8"):
        special = F.when(F.lower(c).rlike(r"^[+-]?(inf|infinity|nan)$"), c)
        value = F.coalesce(F.coalesce(F.when(c.rlike(NUMBER_TEXT), c), special).try_cast("double"), F.lit(0.0))
    elif type_name == "numeric":
        whole = F.when(~misfit(c, type_name), c) if numeric_type == NUMERIC else F.when(c.rlike(NUMBER_TEXT), c)
        value = whole.try_cast(numeric_type)
    elif type_name == "money":
        value = money(c)
    elif type_name in ("json", "jsonb"):
        value = F.coalesce(F.try_parse_json(c), F.to_variant_object(F.struct(c.alias("raw"))))
    else:
        return c
    return F.when(c.isNotNull(), value)


def array_elements(c: Column) -> Column:
    """Element texts of an array literal, unquoted and unescaped; ``NULL`` elements are null.

    A text that is not in braces gives null, and :func:`malformed_array` its raw text.
    """
    inner = F.substring(c, F.lit(2), F.length(c) - 2)
    raw = F.regexp_extract_all(inner, F.lit(ARRAY_ELEMENT), F.lit(1))

    def element(e: Column) -> Column:
        trimmed = F.trim(e)
        body = F.substring(trimmed, F.lit(2), F.length(trimmed) - 2)
        unescaped = F.regexp_replace(body, r"\\(.)", "$1")
        return F.when(trimmed.startswith('"'), unescaped).when(trimmed != "NULL", trimmed)

    return F.when(c.startswith("{") & c.endswith("}"), F.transform(raw, element))


def malformed_array(c: Column) -> Column:
    """The raw text where it is no array literal, else null: what :func:`array_elements` cannot hold."""
    return F.when(~(c.startswith("{") & c.endswith("}")), c)


def decode_array(c: Column, type_name: str) -> Column:
    return F.transform(array_elements(c), lambda e: decode_scalar(e, type_name))


def decode(c: Column, oid: int) -> Column:
    """Typed column for a text value of a known type id."""
    name, is_array = type_of_oid(oid)
    return decode_array(c, name) if is_array else decode_scalar(c, name)


def unquote(raw: Column) -> Column:
    """Log value without its quotes, doubled quotes undone."""

    def strip(v: Column) -> Column:
        body = F.replace(F.substring(v, F.lit(2), F.length(v) - 2), F.lit("''"), F.lit("'"))
        return F.when(v.startswith("'") & v.endswith("'") & (F.length(v) >= 2), body).otherwise(v)

    return let(F.trim(raw), strip)


def infer_json(text: Column) -> Column:
    """JSON token of an untyped value: null, integer, float, boolean, else a string."""

    def fraction(t: Column) -> Column:
        plain = lambda n: F.when(F.abs(n) < float("inf"), double_text(n)).otherwise(quote_json(t))
        return let(t.try_cast("double"), plain)

    def number(t: Column) -> Column:
        return F.when(t.rlike(INTEGER_TEXT), F.coalesce(t.try_cast("bigint").cast("string"), fraction(t))).otherwise(
            fraction(t)
        )

    def token(t: Column) -> Column:
        return (
            F.when(t.isNull() | (t == ""), F.lit("null"))
            .when(t.rlike(NUMBER_TEXT), number(t))
            .when((F.length(t) <= 5) & F.lower(t).isin("true", "false", "null"), F.lower(t))
            .otherwise(quote_json(t))
        )

    return let(F.trim(text), token)
