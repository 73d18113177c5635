"""Log lines, JSON documents, envelopes and routing."""

import pytest
from pyspark.sql import functions as F

from driftline.config import SyncTask
from driftline.operators import routing
from driftline.plans.sync import run_task
from driftline.sources import changelog, documents, tables

LINES = [
    ("0/1", "BEGIN 5"),
    (
        "0/2",
        "table public.items: UPDATE: id[uuid]:'0b1f7c52-93de-4a07-8f6e-2d5c1ab94e30' name[text]:'Lamp no. 3, oak'"
        " category[character varying]:'Möbel (家具)'",
    ),
    ("0/3", "table a.b.c: INSERT: id[integer]:7 t[text]:'it''s [x]:1 new-tuple: y' arr[integer[]]:'{1,2}' e[text]:'' n[text]:null"),
    ("0/4", "table public.u: UPDATE: old-key: id[integer]:1 new-tuple: id[integer]:2 name[text]:'007' live[boolean]:true"),
    ("0/5", "table public.u: DELETE: (no-tuple-data)"),
    ("0/6", "table public.u: TRUNCATE: (no-flags)"),
    ("0/7", "table u: INSERT: id[integer]:1 id[integer]:2 big[text]:unchanged-toast-datum"),
    ("0/8", "table nonsense"),
    ("0/9", "COMMIT 5"),
    ("0/A", "table public.u: UPDATE: old-key: id[integer]:1 new-key: id[integer]:3"),
]


@pytest.fixture(scope="module")
def decoded(spark):
    rows = changelog.decode_lines(spark.createDataFrame(LINES, "lsn string, data string"))
    texts = F.transform_values("fields", lambda k, v: changelog._text(v.getField("raw")))
    made = {
        "json": changelog.inferred_json(F.col("fields")),
        "texts": texts,
        "old_id": changelog.field_text(F.col("old_fields"), "id"),
        "unchanged": changelog.unchanged_fields(F.col("fields")),
    }
    return {r.lsn: r for r in rows.withColumns(made).collect()}


def test_headers(decoded):
    assert {k: (r.op, r.schema_name, r.table_name) for k, r in decoded.items()} == {
        "0/2": ("update", "public", "items"),
        "0/3": ("create", "a.b", "c"),
        "0/4": ("update", "public", "u"),
        "0/5": ("delete", "public", "u"),
        "0/7": ("create", "public", "u"),
        "0/A": ("update", "public", "u"),
    }


def test_fields(decoded):
    text = lambda k: decoded[k].texts
    assert text("0/2")["name"] == "Lamp no. 3, oak" and text("0/2")["category"] == "Möbel (家具)"
    assert text("0/3") == {"id": "7", "t": "it's [x]:1 new-tuple: y", "arr": "{1,2}", "e": "", "n": None}
    assert decoded["0/3"].fields["arr"].type == "integer[]" and decoded["0/3"].old_fields is None
    assert text("0/4") == {"id": "2", "name": "007", "live": "true"} and decoded["0/4"].old_id == "1"
    assert text("0/5") == {} and text("0/A") == {"id": "3"}
    assert text("0/7")["id"] == "2" and decoded["0/7"].unchanged == ["big"]
    assert decoded["0/4"].json == '{"id":2,"name":7,"live":true}'
    assert decoded["0/3"].json.endswith('"e":null,"n":null}')


def test_typed_fields(spark):
    rows = changelog.decode_lines(spark.createDataFrame(LINES, "lsn string, data string"))
    typed = changelog.typed_fields(rows, {"id": "int4", "name": "text", "live": "bool"})
    r = typed.where("lsn = '0/4'").first()
    assert (r.id, r.name, r.live) == (2, "007", True)


def test_change_rows(spark):
    """Types, left-out fields and missing positions on the way into a task."""
    lines = [
        ("0/10", "table public.u: UPDATE: id[integer]:1 big[text]:unchanged-toast-datum n[integer]:5"),
        (None, "table public.u: INSERT: id[integer]:2 big[text]:'x' n[integer]:6"),
        ("0/11", "table public.u: DELETE: id[integer]:3"),
    ]
    df = spark.createDataFrame(lines, "lsn string, data string")
    rows = changelog.change_rows(df, {"id": "int4", "big": "text", "n": "int4"})
    outcome = run_task(rows, SyncTask("t", "public.u", "u"))
    got = sorted((r.id, r.big, r.n, r["__op"], r["__lsn"], r["__unchanged"]) for r in outcome.accepted.collect())
    assert got == [(1, None, 5, "update", 16, ["big"]), (3, None, None, "delete", 17, [])]
    assert [r.error for r in outcome.rejected.collect()] == ["Missing position"]


def test_undecodable(spark):
    rows = changelog.undecodable_lines(spark.createDataFrame(LINES, "lsn string, data string"))
    assert [r.lsn for r in rows.collect()] == ["0/8"]


def test_long_values(spark):
    """Whole texts go through, however many quotes they hold."""
    texts = ["x''" * 50_000, "word " * 300_000, "]:'' new-tuple: " * 5_000]
    df = spark.createDataFrame([(i, f"table public.t: INSERT: t[text]:'{t}' id[integer]:{i}") for i, t in enumerate(texts)], "i int, data string")
    rows = changelog.typed_fields(changelog.decode_lines(df), {"t": "text", "id": "int4"}).orderBy("i").collect()
    assert [r.t for r in rows] == [t.replace("''", "'") for t in texts] and [r.id for r in rows] == [0, 1, 2]


def test_arrays_of_documents(spark):
    raws = [
        '[{"sku": "a"}, {"sku": "b"}, {"sku": "c"}]',
        '[\n {"sku": 7, "size": {"wide": 2.5}}, \n {"tags": ["x", "y"]}]',
        "[]",
        '[{"sku": 1}, {"price": ]',
        '[1, {"a": 1}, "x", [{"in": 1}], null]',
        "nope",
        '{"not": "array"}',
        '[{"id":{"a":{"b":1}}}, {"bad": }',
    ]
    df = spark.createDataFrame(list(enumerate(raws)), "k int, raw string")
    got = {}
    for r in documents.explode_array(df, "raw").orderBy("k", "pos").collect():
        got.setdefault(r.k, []).append(r.item)
    assert got == {
        0: ['{"sku":"a"}', '{"sku":"b"}', '{"sku":"c"}'],
        1: ['{"size":{"wide":2.5},"sku":7}', '{"tags":["x","y"]}'],
        3: ['{"sku":1}'],
        4: ['{"a":1}'],
        7: ['{"id":{"a":{"b":1}}}'],
    }
    skipped = {r.k: r.n for r in df.select("k", documents.skipped_items(F.col("raw")).alias("n")).collect()}
    assert skipped == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: None, 6: None, 7: 1}


def test_ingest(spark):
    df = spark.createDataFrame([("true",), ("42",), ('"hello"',), ("[1,2,3]",), ('{"k":"é"}',), ("{",), ("x" * 40,)], "raw string")
    checked = documents.check_documents(df, "raw", 10)
    assert [r.error for r in checked.collect()] == [None] * 5 + ["The document is not valid JSON", "The document has more than 10 bytes"]
    assert documents.good_documents(checked).count() == 5 and documents.bad_documents(checked).count() == 2


def test_routing_by_field(spark):
    raws = ['{"table": "users", "id": 1}', '{"id": 1}', "not json", '{"table": "users\\"with\\"quotes"}', '  {  "table"  :  "users"  }  ']
    df = spark.createDataFrame(list(enumerate(raws)), "k int, raw string")
    got = [(r.route, r.error) for r in documents.route_by_field(df, "raw").orderBy("k").collect()]
    assert got == [
        ("users", None),
        (None, "The object has no field table"),
        (None, "The text is no JSON object"),
        ('users"with"quotes', None),
        ("users", None),
    ]


def test_index_lookup(spark):
    tasks = [SyncTask("1", "public.users", "u"), SyncTask("2", "orders", "o"), SyncTask("3", 'app."Users"', "au")]
    rows = [("public", "Users"), ("app", "users"), ("x", "users"), ("y", "ORDERS"), ("z", "zzz"), (None, "orders"), ("", '"users"')]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, schema_name string, table_name string")
    got = [r["index"] for r in routing.route_to_index(df, tasks).orderBy("i").collect()]
    assert got == ["u", "au", "au", "o", "zzz", "o", "au"]


def test_fan_out(spark):
    tasks = [SyncTask("q", "public.users", "a"), SyncTask("b", "users", "b")]
    df = spark.createDataFrame([(1, "public", "users"), (2, "app", "users"), (3, "", "users"), (4, "public", "x")], "i int, schema_name string, table_name string")
    got = sorted((r.i, r.task_id) for r in routing.fan_out(df, tasks).collect())
    assert got == [(1, "b"), (1, "q"), (2, "b"), (3, "b")]


def test_union_of_sources(spark):
    both = tables.union_sources({"x": spark.sql("SELECT 1 AS a"), "y": spark.sql("SELECT 2 AS b")})
    assert sorted((r.source_name, r.a, r.b) for r in both.collect()) == [("x", 1, None), ("y", None, 2)]


def test_replay(spark):
    log = spark.range(100).selectExpr("id AS lsn_num", "'t' AS table_name")
    assert [r.lsn_num for r in changelog.replay(log, 10, 90, limit=3).collect()] == [10, 11, 12]
    plan = changelog.replay_plan(log, 10, 20).first()
    assert (plan.events, plan.first_lsn, plan.last_lsn) == (11, 10, 20)
