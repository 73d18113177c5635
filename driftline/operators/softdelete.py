"""Rows whose marker field says that they are deleted."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.config import SoftDelete
from driftline.functions.values import json_equals
from driftline.operators import OLD, OP, is_meta


def marked(schema: T.StructType, spec: SoftDelete) -> Column:
    """Two-valued: the marker field holds one of the delete values."""
    if spec.field not in schema.fieldNames():
        return F.lit(False)
    c, dtype = F.col(f"`{spec.field}`"), schema[spec.field].dataType
    tests = [t for t in (json_equals(c, dtype, v) for v in spec.delete_values) if t is not None]
    return F.coalesce(reduce(or_, tests), F.lit(False)) if tests else F.lit(False)


def soft_delete_changes(df: DataFrame, spec: SoftDelete) -> DataFrame:
    """Marked updates become deletes; with an old image present the delete carries that image."""
    if not spec.on_cdc:
        return df
    hit = (F.col(OP) == "update") & marked(df.schema, spec)
    columns = []
    old = df.schema[OLD].dataType if OLD in df.columns else None
    for name in df.columns:
        c = F.col(f"`{name}`")
        if name == OP:
            c = F.when(hit, F.lit("delete")).otherwise(c)
        elif old is not None and not is_meta(name) and name in old.fieldNames():
            previous = F.col(OLD).getField(name)
            c = F.when(hit & F.col(OLD).isNotNull(), previous).otherwise(c)
        columns.append(c.alias(name))
    return df.select(*columns)


def soft_delete_rows(df: DataFrame, spec: SoftDelete) -> DataFrame:
    """Full-table rows that are marked are left out."""
    return df.where(~marked(df.schema, spec)) if spec.on_full_sync else df
