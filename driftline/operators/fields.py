"""Field reshaping: include and exclude lists, transforms and mappings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.config import (
    AddField,
    AddTimestamp,
    Compute,
    Convert,
    Extract,
    FieldMap,
    Lowercase,
    RemoveField,
    Rename,
    Transforms,
    Uppercase,
)
from driftline.functions.jsondocs import rfc3339
from driftline.functions.values import (
    composite_text,
    json_text,
    literal,
    to_array,
    to_boolean,
    to_number,
    walk_path,
)
from driftline.operators import ERRORS, OP, TABLE, UNCHANGED, is_meta


def _doc_fields(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields if not is_meta(f.name)}


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _rebuild(
    df: DataFrame, doc: dict[str, Column], errors: Sequence[Column] = (), renamed: Mapping[str, str] | None = None
) -> DataFrame:
    """Select reserved columns, the new document columns and the grown error list.

    Names of unchanged fields follow ``renamed``.
    """
    meta = [_col(c) for c in df.columns if is_meta(c) and c not in (ERRORS, UNCHANGED)]
    if UNCHANGED in df.columns:
        names = _col(UNCHANGED)
        if renamed:
            to = F.create_map(*[F.lit(x) for pair in renamed.items() for x in pair])
            names = F.transform(names, lambda n: F.coalesce(F.try_element_at(to, n), n))
        meta.append(names.alias(UNCHANGED))
    if errors:
        found = F.array_compact(F.array(*errors))
        earlier = [_col(ERRORS)] if ERRORS in df.columns else []
        meta.append(F.concat(*earlier, found).alias(ERRORS))
    elif ERRORS in df.columns:
        meta.append(_col(ERRORS))
    return df.select(*meta, *[c.alias(name) for name, c in doc.items()])


def _absent(df: DataFrame, name: str) -> Column | None:
    """Whether a row does not carry a field at all: deletes hold only their key, updates may leave fields out."""
    tests = []
    if OP in df.columns:
        tests.append((F.col(OP) == "delete") & _col(name).isNull())
    if UNCHANGED in df.columns:
        tests.append(F.array_contains(UNCHANGED, name))
    return reduce(or_, [F.coalesce(t, F.lit(False)) for t in tests]) if tests else None


def select_fields(
    df: DataFrame, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None
) -> DataFrame:
    """Keep only ``include`` fields, then drop ``exclude`` fields; names that are absent do not matter."""
    names = [n for n in _doc_fields(df) if (include is None or n in include) and n not in (exclude or ())]
    return _rebuild(df, {n: _col(n) for n in names})


# --- transforms -----------------------------------------------------------------------------


def _compute(expression: str, fields: dict[str, T.DataType]) -> Column | None:
    if not (expression.startswith("concat(") and expression.endswith(")")):
        return None
    names = [n.strip() for n in expression[len("concat(") : -1].split(",")]
    parts = [json_text(_col(n), fields[n]) for n in names if n in fields]
    return F.concat(*parts) if parts else F.lit("")


def _convert(name: str, dtype: T.DataType, to_type: str) -> tuple[Column, Column | None]:
    c = _col(name)
    if to_type == "string":
        return json_text(c, dtype), None
    if to_type == "number":
        return to_number(c, dtype)
    if to_type == "boolean":
        return to_boolean(c, dtype), None
    if to_type == "array":
        return to_array(c, dtype), None
    return c, F.lit(f"No conversion to type {to_type}")


def transform_fields(df: DataFrame, rules: Sequence[Any]) -> DataFrame:
    """Field rules in order. Every rule reads the input row; renamed fields lose their old name.

    A conversion that fails adds its message to ``__errors`` and leaves the value null. Fields a
    row does not carry are not converted.
    """
    if not rules:
        return df
    fields = _doc_fields(df)
    made: dict[str, Column] = {}
    errors: list[Column] = []
    renamed: dict[str, str] = {}
    for rule in rules:
        if isinstance(rule, Rename):
            if rule.source in fields:
                made[rule.to] = _col(rule.source)
                renamed[rule.source] = rule.to
        elif isinstance(rule, Convert):
            if rule.field in fields:
                value, error = _convert(rule.field, fields[rule.field], rule.to_type)
                absent = _absent(df, rule.field)
                made[rule.field] = value if absent is None else F.when(~absent, value)
                if error is not None:
                    errors.append(error if absent is None else F.when(~absent, error))
        elif isinstance(rule, Extract):
            found = walk_path(_col(rule.source), fields[rule.source], rule.path) if rule.source in fields else None
            if found is not None:
                made[rule.to] = found[0]
        elif isinstance(rule, Compute):
            value = _compute(rule.expression, fields)
            if value is not None:
                made[rule.to] = value
        else:
            raise TypeError(f"not a field transform: {rule!r}")
    kept = {n: _col(n) for n in fields if n not in renamed and n not in made}
    return _rebuild(df, {**kept, **made}, errors, renamed)


def apply_globals(df: DataFrame, rules: Sequence[Any], clock: Column | None = None) -> DataFrame:
    """Global rules in order. ``clock`` replaces the current time, for repeatable runs."""
    for rule in rules:
        if isinstance(rule, AddField):
            df = df.withColumn(rule.name, literal(rule.value))
        elif isinstance(rule, RemoveField):
            df = df.drop(rule.name)
        elif isinstance(rule, AddTimestamp):
            now = F.current_timestamp() if clock is None else clock
            df = df.withColumn(rule.field, rfc3339(now))
        elif isinstance(rule, (Lowercase, Uppercase)):
            change = F.lower if isinstance(rule, Lowercase) else F.upper
            texts = [n for n, t in _doc_fields(df).items() if n in rule.fields and isinstance(t, T.StringType)]
            df = df.withColumns({n: change(_col(n)) for n in texts}) if texts else df
        else:
            raise TypeError(f"not a global transform: {rule!r}")
    return df


def transform(df: DataFrame, spec: Transforms, full_sync: bool = False, clock: Column | None = None) -> DataFrame:
    df = transform_fields(df, spec.fields)
    if full_sync and spec.globals_cdc_only:
        return df
    return apply_globals(df, spec.globals, clock)


# --- mapping --------------------------------------------------------------------------------


def map_fields(df: DataFrame, spec: FieldMap) -> DataFrame:
    """Source to target fields; the rest of the fields follow ``spec.unmapped``."""
    if spec.table is not None and TABLE in df.columns:
        df = df.withColumn(TABLE, F.lit(spec.table))
    if not spec.fields:
        return df
    fields = _doc_fields(df)
    made: dict[str, Column] = {}
    used: set[str] = set()
    renamed: dict[str, str] = {}
    for rule in spec.fields:
        present = rule.source in fields
        if rule.to is None:
            continue
        if rule.simple:
            if present:
                made[rule.to] = _col(rule.source)
                used.add(rule.source)
                renamed[rule.source] = rule.to
        elif rule.sources is not None:
            parts = [s for s in rule.sources if s in fields]
            used.update(parts)
            if parts:
                made[rule.to] = F.concat_ws(rule.separator, *[composite_text(_col(s), fields[s]) for s in parts])
        elif rule.path is not None:
            found = walk_path(_col(rule.source), fields[rule.source], rule.path) if present else None
            if found is not None:
                made[rule.to] = found[0]
                used.add(rule.source)
                renamed[rule.source] = rule.to
        else:
            made[rule.to] = _col(rule.source) if present else literal(rule.default)
            used.add(rule.source)
            renamed[rule.source] = rule.to
    rest = [n for n in fields if n not in used]
    if spec.unmapped == "exclude":
        extra: dict[str, Column] = {}
    elif spec.unmapped == "prefix":
        extra = {f"{spec.prefix}{n}": _col(n) for n in rest}
        renamed |= {n: f"{spec.prefix}{n}" for n in rest}
    else:
        extra = {n: _col(n) for n in rest if n not in made}
    return _rebuild(df, {**made, **extra}, renamed=renamed)
