"""Row filters: table lists, event types and field conditions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.config import Condition, EventFilter
from driftline.functions.identifiers import canonical, table_key
from driftline.functions.values import INTEGRAL, is_numeric, json_equals
from driftline.operators import OP, SCHEMA, TABLE

# Event types a type list can name; truncate and schema changes never pass such a list.
ROW_EVENTS = ("create", "update", "delete")

ALIASES = {"eq": "equals", "ne": "not_equals", "gt": "greater_than", "lt": "less_than"}


def _never() -> Column:
    return F.lit(False)


def _number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _compare(c: Column, dtype: T.DataType, op: str, value: Any) -> Column:
    if not (is_numeric(dtype) and _number(value)):
        return _never()
    # Keep the column bare where types agree: a cast around it would stop file-scan pushdown.
    if isinstance(value, int) and isinstance(dtype, INTEGRAL):
        left, right = c, F.lit(value)
    else:
        left, right = c if isinstance(dtype, T.DoubleType) else c.cast("double"), F.lit(float(value))
    return {
        "greater_than": left > right,
        "less_than": left < right,
        "gte": left >= right,
        "lte": left <= right,
    }[op]


def _membership(c: Column, dtype: T.DataType, values: Iterable[Any]) -> Column:
    values = list(values)
    tests = [json_equals(c, dtype, v) for v in values]
    plain = [v for v, t in zip(values, tests) if t is not None and v is not None and not isinstance(v, (list, dict))]
    matched: list[Column] = []
    if plain:
        matched.append(c.isin(*plain))
    matched += [t for v, t in zip(values, tests) if t is not None and (v is None or isinstance(v, (list, dict)))]
    return reduce(or_, matched) if matched else _never()


def predicate(cond: Condition, schema: T.StructType) -> Column:
    """Column of a condition. A null result means false, which is what a filter does with it."""
    op = ALIASES.get(cond.op, cond.op)
    if op == "and":
        return reduce(and_, [predicate(c, schema) for c in cond.conditions], F.lit(True))
    if op == "or":
        return reduce(or_, [predicate(c, schema) for c in cond.conditions], F.lit(False))

    if cond.field not in schema.fieldNames():
        return F.lit(op in ("not_equals", "is_null", "not_in"))
    c, dtype = F.col(f"`{cond.field}`"), schema[cond.field].dataType

    if op == "is_null":
        return c.isNull()
    if op == "is_not_null":
        return c.isNotNull()
    if op == "equals":
        test = json_equals(c, dtype, cond.value)
        return _never() if test is None else test
    if op == "not_equals":
        test = json_equals(c, dtype, cond.value)
        if test is None:
            return F.lit(True)
        return c.isNotNull() if cond.value is None else (~test | c.isNull())
    if op == "contains":
        if isinstance(dtype, T.StringType) and isinstance(cond.value, str):
            return c.contains(cond.value)
        return _never()
    if op in ("greater_than", "less_than", "gte", "lte"):
        return _compare(c, dtype, op, cond.value)
    if op == "in":
        return _membership(c, dtype, cond.values)
    if op == "not_in":
        return ~F.coalesce(_membership(c, dtype, cond.values), F.lit(False))
    if op in ("like", "regex"):
        if isinstance(dtype, T.StringType) and isinstance(cond.value, str):
            return c.like(cond.value) if op == "like" else c.rlike(cond.value)
        return _never()
    raise ValueError(f"unknown condition: {cond.op}")


def flag(cond: Condition, schema: T.StructType) -> Column:
    """The same as a two-valued boolean column."""
    return F.coalesce(predicate(cond, schema), F.lit(False))


def all_of(conditions: Iterable[Condition], schema: T.StructType) -> Column:
    return predicate(Condition("and", conditions=tuple(conditions)), schema)


def table_allowed(table: Column, schema: Column | None, spec: EventFilter) -> Column:
    """White and black lists; an entry matches the bare or the qualified table name."""
    keys = [table_key(table)] + ([table_key(table, schema)] if schema is not None else [])

    def listed(names: Iterable[str]) -> Column:
        wanted = [canonical(n) for n in names]
        return reduce(or_, [k.isin(*wanted) for k in keys]) if wanted else _never()

    allowed = F.lit(True)
    if spec.whitelist is not None:
        allowed = allowed & listed(spec.whitelist)
    if spec.blacklist is not None:
        allowed = allowed & ~listed(spec.blacklist)
    return allowed


def event_allowed(op: Column, spec: EventFilter) -> Column:
    """Event type list. Full-table rows (null op) are not subject to it."""
    if spec.event_types is None:
        return F.lit(True)
    wanted = [t for t in spec.event_types if t in ROW_EVENTS]
    return op.isNull() | (op.isin(*wanted) if wanted else _never())


def filter_events(df: DataFrame, spec: EventFilter, control: Column | None = None) -> DataFrame:
    """Rows that pass table lists, event types and all field conditions.

    ``control`` marks control rows (heartbeats, position marks), which always pass.
    """
    keep = all_of(spec.conditions, df.schema)
    if TABLE in df.columns:
        schema = F.col(SCHEMA) if SCHEMA in df.columns else None
        keep = table_allowed(F.col(TABLE), schema, spec) & keep
    if OP in df.columns:
        keep = event_allowed(F.col(OP), spec) & keep
    if control is not None:
        keep = control | keep
    return df.where(keep)
