"""Table names as lookup keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(name: Column) -> Column:
    """Trimmed name without surrounding double quotes."""
    return F.regexp_replace(F.trim(name), r'^"+|"+$', "")


def table_key(table: Column, schema: Column | None = None) -> Column:
    """Canonical key ``schema.table``, or ``table`` where the schema is absent or blank."""
    bare = F.lower(clean(table))
    if schema is None:
        return bare
    blank = F.coalesce(F.trim(schema) == "", F.lit(True))
    return F.when(blank, bare).otherwise(F.concat(F.lower(clean(schema)), F.lit("."), bare))


def split_schema(name: Column) -> Column:
    """Schema part of ``schema.table``; null when the name has no dot."""
    trimmed = F.trim(name)
    return F.when(trimmed.contains("."), clean(F.substring_index(trimmed, ".", 1)))


def split_table(name: Column) -> Column:
    """Table part: everything after the first dot."""
    trimmed = F.trim(name)
    return clean(F.when(trimmed.contains("."), F.regexp_replace(trimmed, r"^[^.]*\.", "")).otherwise(trimmed))


def canonical(name: str) -> str:
    """Driver-side twin of :func:`table_key` for configured names."""
    schema, dot, table = name.strip().partition(".")
    if not dot:
        return schema.strip().strip('"').lower()
    schema, table = schema.strip().strip('"'), table.strip().strip('"')
    return f"{schema}.{table}".lower() if schema else table.lower()
