"""Columns added, dropped and widened while a log runs."""

import pytest
from pyspark.sql import functions as F

from driftline.functions.pgtypes import OIDS
from driftline.operators import LSN, OP
from driftline.sources import evolution
from driftline.sources.keyed_table import KeyedTable

VERSIONS = [
    (1, 0, [("id", "int2"), ("v", "int4"), ("name", "text")]),
    (1, 10, [("id", "int4"), ("v", "float4"), ("name", "text"), ("at", "date")]),
    (1, 20, [("at", "date"), ("id", "int8"), ("v", "float8")]),
    (2, 5, [("id", "int4"), ("v", "bool")]),
]
SCHEMA = "rel int, pos bigint, columns array<struct<name:string,type_id:int>>"


@pytest.fixture
def versions(spark):
    return spark.createDataFrame([(r, p, [(n, OIDS[t]) for n, t in c]) for r, p, c in VERSIONS], SCHEMA)


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("int2", "int8", "int8"), ("int4", "float4", "float8"), ("int8", "numeric", "numeric"), ("int8", "float8", "text"),
     ("bool", "int4", "text"), ("date", "date", "date"), ("float8", "numeric", "text")],
)
def test_wider_types(a, b, want):
    assert evolution.wider(OIDS[a], OIDS[b]) == evolution.wider(OIDS[b], OIDS[a]) == OIDS[want]


def test_rows_of_all_versions(spark, versions):
    assert evolution.merged_columns(versions.where("rel = 1"), "pos") == {"id": 20, "v": 701, "name": 25, "at": 1082}
    assert evolution.merged_columns(versions, "pos")["v"] == OIDS["text"]
    rows = [(1, 3, ["1", "7", "a"]), (1, 10, ["2", "1.5", None, "2024-01-01"]), (1, 25, ["2024-01-02", "9999999999", "2.5"]), (1, 26, ["2024-01-03"])]
    changes = spark.createDataFrame(rows, "rel int, pos bigint, tuple array<string>")
    got = evolution.evolving_rows(changes, versions.where("rel = 1"), "rel", "pos")
    assert [(f.name, f.dataType.simpleString()) for f in got.schema.fields][2:] == [("id", "bigint"), ("v", "double"), ("name", "string"), ("at", "string")]
    assert [tuple(r)[2:] for r in got.orderBy("pos").collect()] == [
        (1, 7.0, "a", None), (2, 1.5, None, "2024-01-01"), (9999999999, 2.5, None, "2024-01-02"), (None, None, None, "2024-01-03"),
    ]


def test_tables_under_a_later_schema(spark, folder):
    change = lambda rows, schema: spark.createDataFrame(rows, f"{schema}, {OP} string, {LSN} bigint")
    first = KeyedTable(spark, f"{folder}/t", ["k"], "k int, a int, gone string")
    first.write_base(spark.createDataFrame([(1, 1, "x"), (2, 2, "y")], "k int, a int, gone string"))
    first.write_batch(change([(2, 20, "z", "update", 1)], "k int, a int, gone string"), 1)
    files = lambda: sorted(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path").toPandas().path)
    before = files()
    wide = evolution.evolved(first, spark.createDataFrame([], "k bigint, a bigint, more double").schema)
    assert files() == before
    wide.write_batch(change([(3, 5_000_000_000, 0.5, "create", 2)], "k bigint, a bigint, more double"), 2)
    assert sorted(map(tuple, wide.current().collect())) == [(1, 1, None), (2, 20, None), (3, 5_000_000_000, 0.5)]
    text = evolution.evolved(wide, spark.createDataFrame([], "k bigint, a string, more double").schema)
    text.write_batch(change([(1, "one", None, "update", 3), (2, None, None, "delete", 4)], "k bigint, a string, more double"), 3)
    assert sorted(map(tuple, text.current().collect())) == [(1, "one", None), (3, "5000000000", 0.5)]
    text.compact()
    assert text.current().where(F.col("k") == 3).first()["a"] == "5000000000"
