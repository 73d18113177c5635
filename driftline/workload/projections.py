"""Filters, transforms, mappings and soft deletes (section B)."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.config import (
    AddField,
    AddTimestamp,
    Compute,
    Condition,
    Convert,
    EventFilter,
    Extract,
    FieldMap,
    Lowercase,
    RemoveField,
    Rename,
    SoftDelete,
    SyncTask,
    Transforms,
    Uppercase,
)
from driftline.operators import OLD, OP, TABLE, conditions, fields, routing, softdelete
from driftline.plans.sync import run_task
from driftline.workload.base import GAPS, LOG, Tables, query

# --- conditions -----------------------------------------------------------------------------


def where(df: DataFrame, *specs: dict[str, Any]) -> DataFrame:
    parsed = [Condition.parse(s) for s in specs]
    return conditions.filter_events(df, EventFilter(conditions=parsed))


def mixed(t: Tables) -> DataFrame:
    """Change rows of several tables; full-table rows have no operation."""
    full = t.region.select(F.lit("Regions").alias("__table"), F.col("r_regionkey").cast("bigint").alias("event_id"))
    rows = t.change_rows.withColumn(TABLE, F.concat(F.lit("Items_"), F.col("event_type")))
    return rows.unionByName(full, allowMissingColumns=True)


@query(
    "b01_table_lists",
    "SELECT event_id, 'Items_' || event_type AS table_name FROM events WHERE event_type IN ('view', 'click')",
)
def table_lists(t: Tables) -> DataFrame:
    spec = EventFilter(
        whitelist=["items_view", "public.Items_click", '"Items_error"'], blacklist=["public.items_error", "other"]
    )
    return conditions.filter_events(mixed(t), spec).select("event_id", F.col(TABLE).alias("table_name"))


@query(
    "b02_event_types",
    f"""WITH {LOG} SELECT event_id, op FROM chg WHERE op IN ('create', 'delete')
    UNION ALL SELECT r_regionkey, NULL FROM region""",
)
def event_types(t: Tables) -> DataFrame:
    spec = EventFilter(event_types=["create", "delete", "truncate"])
    return conditions.filter_events(mixed(t), spec).select("event_id", F.col(OP).alias("op"))


@query("b03_equals", f"WITH {GAPS} SELECT event_id, kind FROM gaps WHERE kind = 'click'")
def equals(t: Tables) -> DataFrame:
    return where(t.gaps, {"op": "equals", "field": "kind", "value": "click"}).select("event_id", "kind")


@query(
    "b03_equals_typed",
    f"""WITH {GAPS} SELECT event_id, kind IS NULL AS null_match, false AS text_number, owner = 7 AS number_match,
    false AS absent FROM gaps""",
)
def equals_typed(t: Tables) -> DataFrame:
    """A null literal matches nulls; literals of another type family and absent fields never match."""
    schema = t.gaps.schema
    test = lambda field, value: conditions.flag(Condition("equals", field, value), schema)
    return t.gaps.select(
        "event_id",
        test("kind", None).alias("null_match"),
        test("owner", "7").alias("text_number"),
        test("owner", 7).alias("number_match"),
        test("nowhere", None).alias("absent"),
    )


@query("b04_not_equals", f"WITH {GAPS} SELECT event_id, kind FROM gaps WHERE kind IS DISTINCT FROM 'click'")
def not_equals(t: Tables) -> DataFrame:
    absent = {"op": "not_equals", "field": "nowhere", "value": 1}
    return where(t.gaps, {"op": "not_equals", "field": "kind", "value": "click"}, absent).select("event_id", "kind")


@query("b05_contains", f"WITH {GAPS} SELECT event_id, kind FROM gaps WHERE contains(kind, 'r')")
def contains(t: Tables) -> DataFrame:
    return where(t.gaps, {"op": "contains", "field": "kind", "value": "r"}).select("event_id", "kind")


@query("b06_greater_than", f"WITH {GAPS} SELECT event_id, amount FROM gaps WHERE amount > 12.5 AND owner > 30")
def greater_than(t: Tables) -> DataFrame:
    big = {"op": "greater_than", "field": "amount", "value": 12.5}
    return where(t.gaps, big, {"op": "greater_than", "field": "owner", "value": 30}).select("event_id", "amount")


@query("b07_less_than", f"WITH {GAPS} SELECT event_id, amount FROM gaps WHERE amount < 12.5")
def less_than(t: Tables) -> DataFrame:
    return where(t.gaps, {"op": "less_than", "field": "amount", "value": 12.5}).select("event_id", "amount")


@query("b08_in", f"WITH {GAPS} SELECT event_id, kind FROM gaps WHERE kind IN ('click', 'error') OR kind IS NULL")
def in_list(t: Tables) -> DataFrame:
    return where(t.gaps, {"op": "in", "field": "kind", "values": ["click", "error", None, 5]}).select("event_id", "kind")


@query("b09_is_null", f"WITH {GAPS} SELECT event_id FROM gaps WHERE kind IS NULL")
def is_null(t: Tables) -> DataFrame:
    return where(t.gaps, {"op": "is_null", "field": "kind"}, {"op": "is_null", "field": "nowhere"}).select("event_id")


@query("b10_is_not_null", f"WITH {GAPS} SELECT event_id, amount FROM gaps WHERE amount IS NOT NULL")
def is_not_null(t: Tables) -> DataFrame:
    return where(t.gaps, {"op": "is_not_null", "field": "amount"}).select("event_id", "amount")


NESTED = {
    "op": "or",
    "conditions": [
        {"op": "and", "conditions": [{"op": "equals", "field": "kind", "value": "click"}, {"op": "and", "conditions": []}]},
        {"op": "or", "conditions": []},
        {"op": "and", "conditions": [{"op": "is_null", "field": "kind"}, {"op": "less_than", "field": "owner", "value": 50}]},
    ],
}


@query(
    "b11_and",
    f"WITH {GAPS} SELECT event_id FROM gaps WHERE kind = 'click' AND amount > 10 AND owner < 100",
)
def and_(t: Tables) -> DataFrame:
    parts = [
        {"op": "equals", "field": "kind", "value": "click"},
        {"op": "greater_than", "field": "amount", "value": 10},
        {"op": "less_than", "field": "owner", "value": 100},
    ]
    return where(t.gaps, {"op": "and", "conditions": parts}).select("event_id")


@query("b12_or", f"WITH {GAPS} SELECT event_id, kind FROM gaps WHERE kind = 'click' OR (kind IS NULL AND owner < 50)")
def or_(t: Tables) -> DataFrame:
    return where(t.gaps, NESTED).select("event_id", "kind")


@query(
    "b13_conditions_anded",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000 AND contains(o_orderpriority, 'HIGH')",
)
def conditions_anded(t: Tables) -> DataFrame:
    return where(
        t.orders,
        {"op": "equals", "field": "o_orderstatus", "value": "O"},
        {"op": "greater_than", "field": "o_totalprice", "value": 100000},
        {"op": "contains", "field": "o_orderpriority", "value": "HIGH"},
    ).select("o_orderkey")


@query(
    "b14_whole_event_filter",
    f"""WITH {LOG} SELECT event_id, 'Items_' || event_type AS table_name FROM chg
      WHERE event_type IN ('view', 'error', 'signup') AND op IN ('create', 'update') AND value > 5
    UNION ALL SELECT r_regionkey, 'Regions' FROM region""",
)
def whole_event_filter(t: Tables) -> DataFrame:
    """Table list, event types and conditions together; the control rows pass in any case."""
    spec = EventFilter.parse(
        {
            "tables": {"whitelist": ["Items_view", "Items_error", "Items_signup"]},
            "event_types": ["create", "update"],
            "conditions": [{"op": "greater_than", "field": "value", "value": 5}],
        }
    )
    kept = conditions.filter_events(mixed(t), spec, control=F.col(TABLE) == "Regions")
    return kept.select("event_id", F.col(TABLE).alias("table_name"))


@query("b15_field_lists", "SELECT o_orderkey, o_totalprice FROM orders")
def field_lists(t: Tables) -> DataFrame:
    return fields.select_fields(t.orders, ["o_orderkey", "o_totalprice", "o_orderdate", "absent"], ["o_orderdate"])


@query(
    "b16_filter_expressions",
    r"""SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice >= 50000 AND o_totalprice <= 400000
    AND o_orderstatus <> 'P' AND o_custkey NOT IN (1, 2, 3) AND o_orderpriority LIKE '%-%I%' AND regexp_matches(o_orderpriority, '^[1-4]-')
    AND o_orderkey > 10 AND o_orderkey < 1000000000000000""",
)
def filter_expressions(t: Tables) -> DataFrame:
    specs = [
        ("o_totalprice", "gte", 50000),
        ("o_totalprice", "lte", 400000),
        ("o_orderstatus", "ne", "P"),
        ("o_custkey", "not_in", [1, 2, 3]),
        ("o_orderpriority", "like", "%-%I%"),
        ("o_orderpriority", "regex", "^[1-4]-"),
        ("o_orderkey", "gt", 10),
        ("o_orderkey", "lt", 10**15),
    ]
    rules = [{"field": f, "operator": o, "value": v} for f, o, v in specs]
    return where(t.orders, *rules).select("o_orderkey", "o_orderpriority")


# --- transforms -----------------------------------------------------------------------------


@query(
    "b17_rename",
    "SELECT o_orderkey AS id, o_custkey, o_orderstatus, o_totalprice AS price, o_orderdate, o_orderpriority FROM orders",
)
def rename(t: Tables) -> DataFrame:
    return fields.transform_fields(t.orders, [Rename("o_orderkey", "id"), Rename("o_totalprice", "price"), Rename("x", "y")])


@query(
    "b18_convert_string",
    """SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_name,
    c_mktsegment FROM customer""",
)
def convert_string(t: Tables) -> DataFrame:
    return fields.transform_fields(t.customer, [Convert(f, "string") for f in ("c_nationkey", "c_acctbal", "c_name")])


@query(
    "b18_convert_number",
    """SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN value END AS code, value, CASE event_type
      WHEN 'error' THEN 'This value is no number' WHEN 'click' THEN NULL WHEN 'view' THEN NULL
      ELSE '''' || event_type || ''' is no number' END AS error FROM events""",
)
def convert_number(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    code = F.when(kind.isin("click", "view"), F.col("value").cast("string")).when(kind != "error", kind)
    rows = t.events.select("event_id", code.alias("code"), "value")
    done = fields.transform_fields(rows, [Convert("code", "number"), Convert("value", "number")])
    error = F.array_join("__errors", "\n")
    return done.select("event_id", "code", "value", F.when(error != "", error).alias("error"))


@query(
    "b18_convert_boolean",
    """SELECT event_id, event_type = 'click' OR event_type = 'signup' AS word, user_id <> 0 AS number, false AS fraction,
    value > 50 AS flag FROM events""",
)
def convert_boolean(t: Tables) -> DataFrame:
    word = (
        F.when(F.col("event_type") == "click", "TRUE").when(F.col("event_type") == "signup", "1").otherwise("yes")
    )
    rows = t.events.select(
        "event_id",
        word.alias("word"),
        F.col("user_id").alias("number"),
        F.col("value").alias("fraction"),
        (F.col("value") > 50).alias("flag"),
    )
    return fields.transform_fields(rows, [Convert(f, "boolean") for f in ("word", "number", "fraction", "flag")])


@query(
    "b18_convert_array",
    """SELECT vec_id, len(embedding) AS n, '[' || label || ']' AS label, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings""",
)
def convert_array(t: Tables) -> DataFrame:
    rows = fields.transform_fields(t.embeddings, [Convert("embedding", "array"), Convert("label", "array")])
    return rows.select(
        "vec_id",
        F.size("embedding").cast("bigint").alias("n"),
        F.to_json("label").alias("label"),
        F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"),
    )


@query(
    "b19_extract",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id AS owner, value AS second,
    NULL::DOUBLE AS beyond FROM events""",
)
def extract(t: Tables) -> DataFrame:
    rows = t.events.select(
        "event_id",
        F.parse_json("props").alias("props"),
        F.struct(F.struct("user_id").alias("by"), F.array(F.lit(0.0), F.col("value")).alias("list")).alias("doc"),
    )
    rules = [
        Extract("props", "k", "k"),
        Extract("doc", "by.user_id", "owner"),
        Extract("doc", "list.1", "second"),
        Extract("doc", "list.7", "beyond"),
        Extract("doc", "list.x", "never"),
        Extract("doc", "missing", "never"),
    ]
    done = fields.transform_fields(rows, rules)
    if "never" in done.columns:
        raise AssertionError("a path that cannot exist must not make a field")
    return done.select("event_id", F.col("k").cast("bigint").alias("k"), "owner", "second", "beyond")


@query(
    "b20_compute",
    f"""WITH {GAPS} SELECT event_id, coalesce(kind, 'null') || owner || coalesce(CAST(amount AS VARCHAR), 'null') AS label FROM gaps""",
)
def compute(t: Tables) -> DataFrame:
    rules = [Compute("concat(kind, owner , nowhere, amount)", "label"), Compute("upper(kind)", "unknown")]
    return fields.transform_fields(t.gaps, rules).select("event_id", "label")


@query(
    "b21_pass_through",
    """SELECT n_nationkey, n_name AS nation, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation""",
)
def pass_through(t: Tables) -> DataFrame:
    return fields.transform_fields(t.nation, [Rename("n_name", "nation"), Convert("n_regionkey", "string")])


CLOCK = "2024-02-01 12:30:45.123456"


@query(
    "b22_add_field",
    "SELECT s_suppkey, s_name, s_nationkey, s_acctbal, 'web' AS channel, CAST(3 AS INTEGER) AS rank, true AS live FROM supplier",
)
def add_field(t: Tables) -> DataFrame:
    return fields.apply_globals(t.supplier, [AddField("channel", "web"), AddField("rank", 3), AddField("live", True)])


@query("b23_remove_field", "SELECT s_suppkey, s_name FROM supplier")
def remove_field(t: Tables) -> DataFrame:
    return fields.apply_globals(t.supplier, [RemoveField("s_nationkey"), RemoveField("s_acctbal"), RemoveField("absent")])


@query(
    "b24_add_timestamp",
    "SELECT s_suppkey, '2024-02-01T12:30:45.123456+00:00' AS synced_at FROM supplier",
)
def add_timestamp(t: Tables) -> DataFrame:
    clock = F.lit(CLOCK).cast("timestamp")
    return fields.apply_globals(t.supplier, [AddTimestamp("synced_at")], clock).select("s_suppkey", "synced_at")


@query("b25_lowercase", "SELECT p_partkey, lower(p_brand) AS p_brand, lower(p_type) AS p_type, p_size FROM part")
def lowercase(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", "p_brand", "p_type", "p_size")
    return fields.apply_globals(rows, [Lowercase(("p_brand", "p_type", "p_size"))])


@query("b26_uppercase", "SELECT doc_id, upper(lang) AS lang, upper(source) AS source, n_chars FROM documents")
def uppercase(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang", "source", "n_chars")
    return fields.apply_globals(rows, [Uppercase(("lang", "source", "n_chars"))])


@query(
    "b27_globals_by_mode",
    """SELECT 'cdc' AS mode, n_nationkey, lower(n_name) AS n_name, 'x' AS tag FROM nation
    UNION ALL SELECT 'full', n_nationkey, n_name, NULL FROM nation""",
)
def globals_by_mode(t: Tables) -> DataFrame:
    spec = Transforms(globals=(Lowercase(("n_name",)), AddField("tag", "x")), globals_cdc_only=True)
    rows = t.nation.select("n_nationkey", "n_name")
    cdc = fields.transform(rows, spec).withColumn("mode", F.lit("cdc"))
    full = fields.transform(rows, spec, full_sync=True).withColumn("mode", F.lit("full"))
    return cdc.unionByName(full, allowMissingColumns=True)


# --- mapping --------------------------------------------------------------------------------


@query("b28_map_table", "SELECT 'catalog' AS table_name, event_id FROM events")
def map_table(t: Tables) -> DataFrame:
    rows = fields.map_fields(t.change_rows, FieldMap(table="catalog"))
    return rows.select(F.col(TABLE).alias("table_name"), "event_id")


@query("b29_map_simple", "SELECT c_custkey AS id, c_name AS title FROM customer")
def map_simple(t: Tables) -> DataFrame:
    spec = FieldMap.parse({"fields": {"c_custkey": "id", "c_name": "title", "absent": "nothing"}, "unmapped_fields_strategy": "exclude"})
    return fields.map_fields(t.customer, spec)


@query(
    "b30_map_default",
    f"WITH {GAPS} SELECT event_id, kind AS label, 'none' AS stock, NULL::VARCHAR AS empty FROM gaps",
)
def map_default(t: Tables) -> DataFrame:
    """The default stands in for a field that is absent; a null that is present stays null."""
    rules = {
        "event_id": "event_id",
        "kind": {"to": "label", "default": "?"},
        "stock": {"to": "stock", "default": "none"},
        "other": {"to": "empty"},
    }
    spec = FieldMap.parse({"fields": rules, "unmapped_fields_strategy": "exclude"})
    return fields.map_fields(t.gaps, spec).withColumn("empty", F.col("empty").cast("string"))


@query(
    "b31_map_composite",
    f"""WITH {GAPS} SELECT event_id, coalesce(kind, '') || ' / ' || owner || ' / ' || coalesce(CAST(amount AS VARCHAR), '') AS label,
    owner || ',' || props AS plain FROM gaps""",
)
def map_composite(t: Tables) -> DataFrame:
    rules = {
        "event_id": "event_id",
        "a": {"to": "label", "sources": ["kind", "absent", "owner", "amount"], "separator": " / "},
        "b": {"to": "plain", "sources": ["owner", "props"]},
        "c": {"to": "never", "sources": ["absent"]},
    }
    return fields.map_fields(t.gaps, FieldMap.parse({"fields": rules, "unmapped_fields_strategy": "exclude"}))


@query("b32_map_nested", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value AS amount FROM events")
def map_nested(t: Tables) -> DataFrame:
    rows = t.events.select(
        "event_id", F.parse_json("props").alias("props"), F.struct(F.array("value").alias("list")).alias("doc")
    )
    rules = {
        "event_id": "event_id",
        "props": {"to": "k", "path": "k"},
        "doc": {"to": "amount", "path": "list.0"},
    }
    done = fields.map_fields(rows, FieldMap.parse({"fields": rules, "unmapped_fields_strategy": "exclude"}))
    return done.withColumn("k", F.col("k").cast("bigint"))


@query(
    "b33_unmapped_include",
    "SELECT s_suppkey AS s_name, s_nationkey, s_acctbal FROM supplier",
)
def unmapped_include(t: Tables) -> DataFrame:
    """An unmapped field never overwrites a target of the same name."""
    return fields.map_fields(t.supplier, FieldMap.parse({"fields": {"s_suppkey": "s_name"}, "unmapped_fields_strategy": "other"}))


@query("b33_unmapped_prefix", "SELECT s_suppkey AS id, s_name AS raw_s_name, s_nationkey AS raw_s_nationkey, s_acctbal AS raw_s_acctbal FROM supplier")
def unmapped_prefix(t: Tables) -> DataFrame:
    spec = {"fields": {"s_suppkey": "id"}, "unmapped_fields_strategy": "prefix", "unmapped_fields_prefix": "raw_"}
    return fields.map_fields(t.supplier, FieldMap.parse(spec))


# --- soft delete ----------------------------------------------------------------------------

GONE = SoftDelete("event_type", ("click", "signup", 1, None))


@query(
    "b34_soft_delete_changes",
    f"""WITH {LOG} SELECT event_id, CASE WHEN op = 'update' AND event_type = 'click' THEN 'delete' ELSE op END AS op, event_type FROM chg""",
)
def soft_delete_changes(t: Tables) -> DataFrame:
    return softdelete.soft_delete_changes(t.change_rows, GONE).select("event_id", F.col(OP).alias("op"), "event_type")


@query(
    "b35_soft_delete_old_image",
    f"""WITH {LOG} SELECT event_id, CASE WHEN op = 'update' AND event_type = 'click' THEN 'delete' ELSE op END AS op,
    CASE WHEN op = 'update' AND event_type = 'click' THEN value - 1 ELSE value END AS value,
    CASE WHEN op = 'update' AND event_type = 'click' THEN 'before' ELSE event_type END AS event_type FROM chg""",
)
def soft_delete_old_image(t: Tables) -> DataFrame:
    old = F.struct((F.col("value") - 1).alias("value"), F.lit("before").alias("event_type"))
    rows = softdelete.soft_delete_changes(t.change_rows.withColumn(OLD, old), GONE)
    return rows.select("event_id", F.col(OP).alias("op"), "value", "event_type")


@query(
    "b36_soft_delete_full_sync",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'",
)
def soft_delete_full_sync(t: Tables) -> DataFrame:
    return softdelete.soft_delete_rows(t.orders, SoftDelete("o_orderstatus", ("F", True))).select("o_orderkey", "o_orderstatus")


# --- whole tasks ----------------------------------------------------------------------------

ORDER_TASK = {
    "id": "orders",
    "table": "public.orders",
    "index": "orders",
    "primary_key": "id",
    "filter": {
        "conditions": [
            {"op": "not_equals", "field": "o_orderpriority", "value": "5-LOW"},
            {"op": "greater_than", "field": "o_totalprice", "value": 1000},
        ]
    },
    "transform": {
        "fields": {
            "public.orders": {
                "key": {"type": "rename", "from": "o_orderkey", "to": "id"},
                "cust": {"type": "convert", "field": "o_custkey", "to_type": "string"},
                "label": {"type": "compute", "expression": "concat(o_orderstatus, o_orderpriority)", "to": "label"},
            }
        },
        "global_transforms": [{"type": "add_field", "name": "origin", "value": "erp"}, {"type": "lowercase", "fields": ["label"]}],
    },
    "mapping": {
        "tables": {
            "orders": {
                "name": "sales",
                "fields": {
                    "id": "id",
                    "o_totalprice": "price",
                    "who": {"to": "who", "sources": ["o_custkey", "origin"], "separator": "@"},
                    "currency": {"to": "currency", "default": "USD"},
                },
            }
        },
        "unmapped_fields_strategy": "prefix",
        "unmapped_fields_prefix": "x_",
    },
    "soft_delete": {"field": "o_orderstatus", "delete_values": ["F"]},
}

ORDER_COLUMNS = """o_orderkey AS id, o_totalprice AS price, o_custkey || '@erp' AS who, 'USD' AS currency,
    lower(o_orderstatus || o_orderpriority) AS x_label, o_orderstatus AS x_o_orderstatus, o_orderpriority AS x_o_orderpriority"""


@query(
    "b37_task_full_sync",
    f"""SELECT {ORDER_COLUMNS} FROM orders WHERE o_orderpriority <> '5-LOW' AND o_totalprice > 1000 AND o_orderstatus <> 'F'""",
)
def task_full_sync(t: Tables) -> DataFrame:
    rows = run_task(t.orders, SyncTask.from_dict(ORDER_TASK), full_sync=True).accepted
    return rows.drop("x_o_orderdate")


@query(
    "b37_task_changes",
    f"""SELECT CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'delete' WHEN o_orderkey % 2 = 0 THEN 'update' ELSE 'create' END AS op,
    'sales' AS table_name, {ORDER_COLUMNS} FROM orders WHERE o_orderpriority <> '5-LOW' AND o_totalprice > 1000""",
)
def task_changes(t: Tables) -> DataFrame:
    rows = t.orders.withColumns(
        {OP: F.when(F.col("o_orderkey") % 2 == 0, "update").otherwise("create"), TABLE: F.lit("orders")}
    )
    done = run_task(rows, SyncTask.from_dict(ORDER_TASK)).accepted
    return done.withColumnsRenamed({OP: "op", TABLE: "table_name"}).drop("x_o_orderdate")


@query(
    "b39_route_by_condition",
    f"""WITH {LOG} SELECT event_id, CASE WHEN op = 'create' AND k < 100 THEN 'new_users' WHEN value > 200 THEN 'vip_users' ELSE 'users' END AS idx,
    sha256(props) AS props_hash FROM chg""",
)
def route_by_condition(t: Tables) -> DataFrame:
    rules = [
        (Condition.parse({"op": "and", "conditions": [{"op": "equals", "field": "op", "value": "create"}, {"op": "less_than", "field": "k", "value": 100}]}), "new_users"),
        (Condition("greater_than", "value", 200), "vip_users"),
    ]
    rows = t.log.withColumn("idx", routing.route_by_condition(t.log, rules, "users"))
    return routing.mask_fields(rows, ["props"]).select("event_id", "idx", "props_hash")
