"""JSON document building and editing on text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rfc3339(ts: Column) -> Column:
    """``2024-01-01T00:00:00.000000+00:00``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def json_array_has(json_array: Column, item: str) -> Column:
    """Whether a JSON array of strings holds ``item``."""
    return F.coalesce(F.array_contains(F.from_json(json_array, "array<string>"), item), F.lit(False))


def json_array_add(json_array: Column, item: str) -> Column:
    """JSON array text with ``item`` at its end, unless it is there already."""
    items = F.from_json(json_array, "array<string>")
    grown = F.array_append(F.coalesce(items, F.array().cast("array<string>")), F.lit(item))
    return F.when(json_array_has(json_array, item), json_array).otherwise(F.to_json(grown))


def json_object(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]))


def json_object_add(json_map: Column, **fields: Column) -> Column:
    """JSON object text with keys added or replaced; values keep their JSON type."""
    current = F.from_json(json_map, "map<string,variant>")
    names = list(fields)
    kept = F.map_filter(current, lambda k, v: ~k.isin(*names))
    tokens = [F.to_variant_object(F.struct(c.alias("v"))) for c in fields.values()]
    added = F.create_map(
        *[x for name, t in zip(names, tokens) for x in (F.lit(name), F.try_variant_get(t, "$.v", "variant"))]
    )
    return F.to_json(F.map_concat(F.coalesce(kept, F.create_map().cast("map<string,variant>")), added))
