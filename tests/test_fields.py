"""Conditions, transforms, mappings and soft deletes on small rows."""

import pytest
from pyspark.sql import functions as F

from driftline.config import Condition, EventFilter, FieldMap, SoftDelete, SyncTask, Transforms
from driftline.operators import ERRORS, OLD, OP, conditions, fields, softdelete
from driftline.plans.sync import run_task


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [(1, "ann", 10.0, True, ["x"]), (2, None, None, None, None), (3, "007", 1.0, False, [])],
        "id bigint, name string, score double, live boolean, tags array<string>",
    )


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


@pytest.mark.parametrize(
    "spec, want",
    [
        ({"op": "equals", "field": "name", "value": "ann"}, [1]),
        ({"op": "equals", "field": "name", "value": None}, [2]),
        ({"op": "equals", "field": "name", "value": 7}, []),
        ({"op": "equals", "field": "score", "value": "1.0"}, []),
        ({"op": "equals", "field": "live", "value": False}, [3]),
        ({"op": "equals", "field": "live", "value": 0}, []),
        ({"op": "equals", "field": "tags", "value": ["x"]}, [1]),
        ({"op": "equals", "field": "tags", "value": []}, [3]),
        ({"op": "equals", "field": "gone", "value": None}, []),
        ({"op": "not_equals", "field": "name", "value": "ann"}, [2, 3]),
        ({"op": "not_equals", "field": "name", "value": None}, [1, 3]),
        ({"op": "not_equals", "field": "name", "value": 7}, [1, 2, 3]),
        ({"op": "not_equals", "field": "gone", "value": 1}, [1, 2, 3]),
        ({"op": "contains", "field": "name", "value": "0"}, [3]),
        ({"op": "contains", "field": "score", "value": "1"}, []),
        ({"op": "contains", "field": "name", "value": 0}, []),
        ({"op": "greater_than", "field": "score", "value": 1}, [1]),
        ({"op": "greater_than", "field": "name", "value": 1}, []),
        ({"op": "less_than", "field": "score", "value": 5.5}, [3]),
        ({"op": "less_than", "field": "id", "value": 2.5}, [1, 2]),
        ({"op": "less_than", "field": "score", "value": True}, []),
        ({"op": "in", "field": "name", "values": ["ann", None]}, [1, 2]),
        ({"op": "in", "field": "name", "values": [7]}, []),
        ({"op": "in", "field": "gone", "values": [None]}, []),
        ({"op": "is_null", "field": "name"}, [2]),
        ({"op": "is_null", "field": "gone"}, [1, 2, 3]),
        ({"op": "is_not_null", "field": "gone"}, []),
        ({"op": "is_not_null", "field": "live"}, [1, 3]),
        ({"op": "and", "conditions": []}, [1, 2, 3]),
        ({"op": "or", "conditions": []}, []),
        ({"op": "not_in", "field": "name", "values": ["ann"]}, [2, 3]),
        ({"op": "like", "field": "name", "value": "a%"}, [1]),
        ({"op": "regex", "field": "name", "value": "^0+7$"}, [3]),
        ({"op": "gte", "field": "score", "value": 10}, [1]),
    ],
)
def test_condition(people, spec, want):
    cond = Condition.parse(spec)
    assert ids(people.where(conditions.predicate(cond, people.schema))) == want
    flagged = people.select("id", conditions.flag(cond, people.schema).alias("f"))
    assert all(r.f is not None for r in flagged.collect()) and ids(flagged.where("f")) == want


def test_event_types_and_tables(spark):
    rows = spark.createDataFrame(
        [(1, "create", "Users", "public"), (2, "truncate", "Users", "public"), (3, None, "Logs", "app"), (4, "delete", "Logs", "app")],
        "id int, __op string, __table string, __schema string",
    )
    assert ids(conditions.filter_events(rows, EventFilter(event_types=["create", "truncate"]))) == [1, 3]
    assert ids(conditions.filter_events(rows, EventFilter(whitelist=["public.users"]))) == [1, 2]
    assert ids(conditions.filter_events(rows, EventFilter(whitelist=["users", "logs"], blacklist=["app.Logs"]))) == [1, 2]
    assert ids(conditions.filter_events(rows, EventFilter(whitelist=[]))) == []


def test_transform_rules_read_the_input_row(people):
    spec = Transforms.parse(
        {
            "fields": [
                {"type": "rename", "from": "name", "to": "title"},
                {"type": "compute", "expression": "concat(name, score)", "to": "label"},
                {"type": "convert", "field": "score", "to_type": "string"},
                {"type": "extract", "from": "tags", "path": "0", "to": "tag"},
            ]
        }
    )
    rows = fields.transform(people, spec).orderBy("id").collect()
    assert set(rows[0].asDict()) == {"id", "title", "label", "score", "tag", "live", "tags", ERRORS} - {ERRORS}
    assert [r.label for r in rows] == ["ann10.0", "nullnull", "0071.0"]
    assert [r.score for r in rows] == ["10.0", "null", "1.0"] and [r.tag for r in rows] == ["x", None, None]


def test_failed_conversions_are_rejected(people):
    spec = {"id": "t", "table": "people", "index": "p", "transform": {"fields": {"people": {"a": {"type": "convert", "field": "name", "to_type": "number"}}}}}
    outcome = run_task(people, SyncTask.from_dict(spec), full_sync=True)
    assert [(r.id, r.name) for r in outcome.accepted.collect()] == [(3, 7.0)]
    bad = {r.error for r in outcome.rejected.collect()}
    assert bad == {"'ann' is no number", "This value is no number"}
    assert ERRORS not in outcome.accepted.columns


def test_unknown_conversion_type_is_an_error(people):
    done = fields.transform_fields(people, Transforms.parse({"fields": [{"type": "convert", "field": "id", "to_type": "date"}]}).fields)
    assert done.where(F.size(ERRORS) == 1).count() == 3


@pytest.mark.parametrize(
    "strategy, want",
    [
        ("include", {"id", "title", "score", "live", "tags"}),
        ("exclude", {"title"}),
        ("prefix", {"title", "_id", "_score", "_live", "_tags"}),
        ("whatever", {"id", "title", "score", "live", "tags"}),
    ],
)
def test_unmapped(people, strategy, want):
    spec = FieldMap.parse({"fields": {"name": "title"}, "unmapped_fields_strategy": strategy})
    assert set(fields.map_fields(people, spec).columns) == want


def test_mapping_cases(spark):
    rows = spark.sql("SELECT 'John' AS first_name, 'Doe' AS last_name, named_struct('city', 'Oslo') AS address, CAST(NULL AS string) AS nick")
    spec = FieldMap.parse(
        {
            "fields": {
                "full": {"to": "full_name", "sources": ["first_name", "last_name"], "separator": " "},
                "address": {"to": "city", "path": "city"},
                "status": {"to": "status", "default": "active"},
                "nick": {"to": "nick", "default": "none"},
                "ignored": {"default": 1},
            },
            "unmapped_fields_strategy": "exclude",
        }
    )
    assert fields.map_fields(rows, spec).first().asDict() == {"full_name": "John Doe", "city": "Oslo", "status": "active", "nick": None}


def test_soft_delete(spark):
    rows = spark.createDataFrame(
        [(1, "update", "yes", 5), (2, "create", "yes", 6), (3, "update", None, 7)], "id int, __op string, gone string, n int"
    )
    spec = SoftDelete("gone", ("yes", True))
    assert [r[OP] for r in softdelete.soft_delete_changes(rows, spec).orderBy("id").collect()] == ["delete", "create", "update"]
    with_old = rows.withColumn(OLD, F.struct((F.col("n") - 1).alias("n")))
    assert [r.n for r in softdelete.soft_delete_changes(with_old, spec).orderBy("id").collect()] == [4, 6, 7]
    assert ids(softdelete.soft_delete_rows(rows, spec)) == [3]
    assert ids(softdelete.soft_delete_rows(rows, SoftDelete("gone", (None,)))) == [1, 2]
    assert ids(softdelete.soft_delete_rows(rows, SoftDelete("absent", (None,)))) == [1, 2, 3]


def test_step_order(spark):
    """By default the marker is looked up under its source name, before a rename hides it."""
    rows = spark.createDataFrame([(1, "update", "yes")], "id int, __op string, gone string")
    task = SyncTask.from_dict(
        {
            "id": "t",
            "table": "t",
            "index": "t",
            "transform": {"fields": [{"type": "rename", "from": "gone", "to": "flag"}]},
            "soft_delete": {"field": "gone", "delete_values": ["yes"]},
        }
    )
    assert run_task(rows, task).accepted.first()[OP] == "delete"
    late = run_task(rows, task, order=("filter", "transform", "map", "soft_delete"))
    assert late.accepted.first()[OP] == "update"


def test_task_with_field_filters(people):
    """Filter expressions of a task join the conditions of its filter."""
    spec = {
        "id": "t",
        "table": "people",
        "index": "p",
        "filter": {"conditions": [{"op": "is_not_null", "field": "name"}]},
        "field_filters": {"include": ["id", "name", "score"], "expressions": [{"field": "score", "operator": "gte", "value": 5}]},
    }
    done = run_task(people, SyncTask.from_dict(spec), full_sync=True).accepted
    assert done.columns == ["id", "name", "score"] and ids(done) == [1]


def test_fields_a_row_does_not_carry(spark):
    """Deletes hold only their key and updates may leave fields out: nothing to convert there."""
    rows = spark.createDataFrame(
        [(1, None, "delete", None), (2, None, "update", ["n"]), (3, None, "update", []), (4, "5", "update", ["x"])],
        "id int, n string, __op string, __unchanged array<string>",
    )
    spec = {
        "id": "t",
        "table": "t",
        "index": "t",
        "transform": {"fields": [{"type": "convert", "field": "n", "to_type": "number"}]},
        "mapping": {"fields": {"n": "amount"}, "unmapped_fields_strategy": "include"},
    }
    outcome = run_task(rows, SyncTask.from_dict(spec))
    got = sorted((r.id, r.amount, r["__unchanged"]) for r in outcome.accepted.collect())
    assert got == [(1, None, None), (2, None, ["amount"]), (4, 5.0, ["x"])]
    assert [r.error for r in outcome.rejected.collect()] == ["This value is no number"]
