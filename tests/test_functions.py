"""Scalar functions on literal cases."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions import errors, identifiers, jsondocs, pgtypes, positions, sizes, values


def column(spark, items, make, dtype="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {dtype}")
    return [r.y for r in rows.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_scalars_by_type(spark):
    oid = pgtypes.OIDS
    decode = lambda items, name: column(spark, items, lambda c: pgtypes.decode(c, oid[name]))
    assert decode(["t", "true", "f", "x", None], "bool") == [True, True, False, False, None]
    assert decode(["32767", "-32768", "32768", "x", "1.5", None], "int2") == [32767, -32768, 0, 0, 0, None]
    assert decode(["2147483647", "x"], "int4") == [2147483647, 0]
    assert decode(["9223372036854775807", "9223372036854775808"], "int8") == [9223372036854775807, 0]
    assert decode(["1.5", "x", "1d", "-2e3"], "float8") == [1.5, 0.0, 0.0, -2000.0]
    assert decode(["$1,234.56", "-5", "abc"], "money") == [Decimal("1234.56"), Decimal("-5.00"), Decimal("0.00")]
    assert decode(["12.50", "x"], "numeric") == [Decimal("12.5"), None]
    assert decode(["\\x00010203", "2001:db8::1"], "bytea") == ["\\x00010203", "2001:db8::1"]
    assert decode(["2024-01-01 00:00:00+00", "1 day"], "timestamptz") == ["2024-01-01 00:00:00+00", "1 day"]


def test_json_by_type(spark):
    got = column(spark, ['{"a":[1,null]}', "oops", "3"], lambda c: F.to_json(pgtypes.decode(c, 3802)))
    assert got == ['{"a":[1,null]}', '{"raw":"oops"}', "3"]


def test_arrays(spark):
    decode = lambda items, oid: column(spark, items, lambda c: pgtypes.decode(c, oid))
    assert decode(["{1,NULL,3}", "{}", "x"], 1007) == [[1, None, 3], [], None]
    assert decode(['{"a,b","c,d"}', '{"","nonempty"}', '{"a\\"b\\\\c",d}'], 1009) == [
        ["a,b", "c,d"],
        ["", "nonempty"],
        ['a"b\\c', "d"],
    ]
    assert decode(["{t,f}"], 1000) == [[True, False]]


def test_type_ids():
    assert pgtypes.type_of_oid(1700) == ("numeric", False)
    assert pgtypes.type_of_oid(1231) == ("numeric", True)
    assert pgtypes.type_of_oid(424242) == ("text", False)


def test_inference(spark):
    items = ["", None, "007", "-5", "1.50", "1e3", "TRUE", "False", "NULL", "abc", 'a"b', "9223372036854775808", "1e999", " x "]
    assert column(spark, items, pgtypes.infer_json) == [
        "null", "null", "7", "-5", "1.5", "1000.0", "true", "false", "null", '"abc"', '"a\\"b"',
        "9.223372036854776e18", '"1e999"', '"x"',
    ]


def test_unquote(spark):
    assert column(spark, ["'it''s'", "''", "'", "plain", " 'x' "], pgtypes.unquote) == ["it's", "", "'", "plain", "x"]


def test_positions(spark):
    rows = spark.createDataFrame(
        [("1/0", "0/FFFFFFFF", 1), ("A/1000", "9/2000", 1), ("0/0", "0/1", -1), ("0/1", "0/01", 0), ("abc", "abd", -1)],
        "a string, b string, want int",
    )
    got = rows.select(positions.lsn_compare(F.col("a"), F.col("b")).alias("c"), "want").collect()
    assert all(r.c == r.want for r in got)
    numbers = ["0/16B3748", "FFFFFFFF/FFFFFFFF", "zz/1", "1", "1/2/3", "+1/1", "11111111111111111/1"]
    assert column(spark, numbers, positions.lsn_number) == [
        Decimal(23803720), Decimal(2**64 - 1), Decimal(1), None, None, Decimal(2**32 + 1), Decimal(1),
    ]
    assert column(spark, [0, 255, 2**32 + 1], positions.lsn_text, "bigint") == ["0/0", "0/FF", "1/1"]


def test_double_text(spark):
    items = [1.0, 1e7, 12345678.5, 1e16, 1.5e-5, 1e-6, 0.1, -2.5e10, 1234567890123456.0]
    assert column(spark, items, values.double_text, "double") == [
        "1.0", "10000000.0", "12345678.5", "1e16", "0.000015", "1e-6", "0.1", "-25000000000.0", "1234567890123456.0",
    ]


def test_to_number(spark):
    rows = spark.createDataFrame([("1.5",), (" 1",), ("1d",), ("nan",), ("1e400",), (None,), ("+.5",)], "x string")
    number, error = values.to_number(F.col("x"), T.StringType())
    got = [tuple(r) for r in rows.select(number, error).collect()]
    assert [g[0] for g in got] == [1.5, None, None, None, None, None, 0.5]
    assert [g[1] is None for g in got] == [True, False, False, False, False, False, True]
    assert got[1][1] == "' 1' is no number" and got[5][1] == "This value is no number"


def test_to_boolean(spark):
    flag = lambda dtype: lambda c: values.to_boolean(c, dtype)
    assert column(spark, ["TRUE", "1", "yes", None], flag(T.StringType())) == [True, True, False, False]
    assert column(spark, [2, 0, None], flag(T.LongType()), "bigint") == [True, False, False]
    assert column(spark, [1.0, 0.5], flag(T.DoubleType()), "double") == [False, False]


@pytest.mark.parametrize(
    "path, want", [("a.b", 1), ("l.1", "y"), ("l.5", None), ("m.k", 2.5), ("v.x.1.z", "deep"), ("v.0", "zero")]
)
def test_paths(spark, path, want):
    row = spark.range(1).select(
        F.struct(
            F.struct(F.lit(1).alias("b")).alias("a"),
            F.array(F.lit("x"), F.lit("y")).alias("l"),
            F.create_map(F.lit("k"), F.lit(2.5)).alias("m"),
            F.parse_json(F.lit('{"x":[0,{"z":"deep"}],"0":"zero"}')).alias("v"),
        ).alias("d")
    )
    found, dtype = values.walk_path(F.col("d"), row.schema["d"].dataType, path)
    got = row.select(found.cast("string") if isinstance(dtype, T.VariantType) else found).first()[0]
    assert got == want


def test_paths_that_cannot_exist(spark):
    kind = T.StructType([T.StructField("a", T.ArrayType(T.LongType())), T.StructField("s", T.StringType())])
    for path in ("b", "a.x", "s.0", "a.0.0"):
        assert values.walk_path(F.col("d"), kind, path) is None


def test_names(spark):
    assert column(spark, [' "Public"."Items" ', "Items", "a.b.c"], identifiers.split_schema) == ["Public", None, "a"]
    assert column(spark, [' "Public"."Items" ', "Items", "a.b.c"], identifiers.split_table) == ["Items", "Items", "b.c"]
    assert identifiers.canonical(' "Public"."Items" ') == "public.items"
    assert identifiers.canonical('"Items"') == "items"


def test_sizes(spark):
    row = spark.range(1).select(
        F.lit("ab").alias("s"),
        F.array(F.lit("x"), F.lit(None).cast("string")).alias("a"),
        F.lit(None).cast("string").alias("n"),
        F.struct(F.lit(1).alias("k")).alias("o"),
        F.lit(True).alias("b"),
    )
    want = 24 + 5 * 25 + (24 + 2) + (24 + 25 + 8) + 8 + (24 + 25 + 16) + 8
    assert row.select(sizes.document_size(row.schema)).first()[0] == want


def test_error_text(spark):
    assert column(spark, ["a\nb", "", "\nb", "a\r\nb"], errors.error_label) == ["a", "Unknown", "", "a"]
    kinds = ["Connection refused", "429 Too Many Requests", "'x' is no number", "boom", "access denied"]
    assert column(spark, kinds, errors.error_class) == ["network", "rate_limit", "data_validation", "unknown", "permission"]


def test_json_editing(spark):
    assert column(spark, ['["a"]', '["sale"]', None], lambda c: jsondocs.json_array_add(c, "sale")) == [
        '["a","sale"]', '["sale"]', '["sale"]',
    ]
    assert column(spark, ['{"k":1.5,"p":1}'], lambda c: jsondocs.json_object_add(c, p=F.lit(5))) == ['{"k":1.5,"p":5}']
    at = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5, 600),)], "x timestamp_ntz")
    assert at.select(jsondocs.rfc3339(F.col("x"))).first()[0] == "2024-01-02T03:04:05.000600+00:00"


def test_numbers_are_not_cut(spark):
    texts = ["1.5", "0.12345678901234", "123456789012345678901234567890", "NaN", "-7.25000000000000", "1e3", None, "0012"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
    got = df.select(pgtypes.decode_scalar(F.col("c"), "numeric").alias("v"), pgtypes.misfit(F.col("c"), "numeric").alias("m"))
    got = [(None if r.v is None else float(r.v), r.m) for r in got.collect()]
    assert got == [(1.5, False), (None, True), (None, True), (None, True), (-7.25, False), (1000.0, False), (None, False), (12.0, False)]
    largest = spark.range(1).select(pgtypes.money(F.lit("$92,233,720,368,547,758.07")).alias("m")).first().m
    assert str(largest) == "92233720368547758.07"
