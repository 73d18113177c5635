"""Task configuration: plain dataclasses, compiled to columns by ``driftline.operators``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

# --- conditions -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Condition:
    """One predicate over document fields.

    ``op`` is one of equals, not_equals, contains, greater_than, less_than, in, is_null,
    is_not_null, and, or; or one of the expression operators eq, ne, gt, gte, lt, lte, not_in,
    like, regex.
    """

    op: str
    field: str | None = None
    value: Any = None
    values: Sequence[Any] = ()
    conditions: Sequence["Condition"] = ()

    @staticmethod
    def parse(spec: "Condition | Mapping[str, Any]") -> "Condition":
        if isinstance(spec, Condition):
            return spec
        value = spec.get("value")
        values = spec.get("values")
        if values is None:
            values = value if isinstance(value, (list, tuple)) else ()
        return Condition(
            op=spec.get("op") or spec["operator"],
            field=spec.get("field"),
            value=value,
            values=tuple(values),
            conditions=tuple(Condition.parse(c) for c in spec.get("conditions", ())),
        )


@dataclass(frozen=True)
class EventFilter:
    whitelist: Sequence[str] | None = None
    blacklist: Sequence[str] | None = None
    event_types: Sequence[str] | None = None
    conditions: Sequence[Condition] = ()

    @staticmethod
    def parse(spec: "EventFilter | Mapping[str, Any]") -> "EventFilter":
        if isinstance(spec, EventFilter):
            return spec
        tables = spec.get("tables") or {}
        return EventFilter(
            whitelist=tables.get("whitelist"),
            blacklist=tables.get("blacklist"),
            event_types=spec.get("event_types"),
            conditions=tuple(Condition.parse(c) for c in spec.get("conditions") or ()),
        )


# --- transforms -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Rename:
    source: str
    to: str


@dataclass(frozen=True)
class Convert:
    field: str
    to_type: str


@dataclass(frozen=True)
class Extract:
    source: str
    path: str
    to: str


@dataclass(frozen=True)
class Compute:
    expression: str
    to: str


@dataclass(frozen=True)
class AddField:
    name: str
    value: Any


@dataclass(frozen=True)
class RemoveField:
    name: str


@dataclass(frozen=True)
class AddTimestamp:
    field: str


@dataclass(frozen=True)
class Lowercase:
    fields: Sequence[str]


@dataclass(frozen=True)
class Uppercase:
    fields: Sequence[str]


def _parse_field_rule(spec: Any) -> Any:
    if not isinstance(spec, Mapping):
        return spec
    kind = spec["type"]
    if kind == "rename":
        return Rename(spec["from"], spec["to"])
    if kind == "convert":
        return Convert(spec["field"], spec["to_type"])
    if kind == "extract":
        return Extract(spec["from"], spec["path"], spec["to"])
    if kind == "compute":
        return Compute(spec["expression"], spec["to"])
    raise ValueError(f"unknown field transform: {kind}")


def _parse_global_rule(spec: Any) -> Any:
    if not isinstance(spec, Mapping):
        return spec
    kind = spec["type"]
    if kind == "add_field":
        return AddField(spec["name"], spec["value"])
    if kind == "remove_field":
        return RemoveField(spec["name"])
    if kind == "add_timestamp":
        return AddTimestamp(spec["field"])
    if kind == "lowercase":
        return Lowercase(tuple(spec["fields"]))
    if kind == "uppercase":
        return Uppercase(tuple(spec["fields"]))
    raise ValueError(f"unknown global transform: {kind}")


@dataclass(frozen=True)
class Transforms:
    """Ordered field rules, then ordered global rules."""

    fields: Sequence[Any] = ()
    globals: Sequence[Any] = ()
    globals_cdc_only: bool = False

    @staticmethod
    def parse(spec: "Transforms | Mapping[str, Any]") -> "Transforms":
        if isinstance(spec, Transforms):
            return spec
        rules = spec.get("fields") or ()
        rules = rules.values() if isinstance(rules, Mapping) else rules
        return Transforms(
            fields=tuple(_parse_field_rule(r) for r in rules),
            globals=tuple(_parse_global_rule(r) for r in spec.get("global_transforms") or ()),
            globals_cdc_only=bool(spec.get("globals_cdc_only", False)),
        )


# --- mapping --------------------------------------------------------------------------------

@dataclass(frozen=True)
class MapField:
    """``source`` to ``to``, optionally composite (``sources``), nested (``path``) or defaulted."""

    source: str
    to: str | None
    default: Any = None
    sources: Sequence[str] | None = None
    separator: str = ","
    path: str | None = None
    simple: bool = False


@dataclass(frozen=True)
class FieldMap:
    fields: Sequence[MapField] = ()
    table: str | None = None
    unmapped: str = "include"
    prefix: str = "_"

    @staticmethod
    def parse(spec: "FieldMap | Mapping[str, Any]") -> "FieldMap":
        if isinstance(spec, FieldMap):
            return spec
        fields = []
        for source, rule in (spec.get("fields") or {}).items():
            if isinstance(rule, str):
                fields.append(MapField(source, rule, simple=True))
            else:
                separator = rule.get("separator")
                fields.append(
                    MapField(
                        source,
                        rule.get("to"),
                        default=rule.get("default"),
                        sources=rule.get("sources"),
                        separator="," if separator is None else separator,
                        path=rule.get("path"),
                    )
                )
        return FieldMap(
            fields=tuple(fields),
            table=spec.get("name"),
            unmapped=spec.get("unmapped_fields_strategy", "include"),
            prefix=spec.get("unmapped_fields_prefix") or "_",
        )


def _table_entry(by_table: Mapping[str, Any], table: str) -> Any:
    """Entry of a per-table setting, by qualified or bare table name."""
    return by_table.get(table, by_table.get(table.rsplit(".", 1)[-1]))


def _for_table(spec: Any, table: str) -> Any:
    """Narrow a setting that is keyed by table name to the one table of this task."""
    if not isinstance(spec, Mapping):
        return spec
    tables = spec.get("tables")
    if isinstance(tables, Mapping) and not {"whitelist", "blacklist"} & set(tables):
        own = _table_entry(tables, table)
        if own is None:
            return None
        return {**{k: v for k, v in spec.items() if k != "tables"}, **own}
    rules = spec.get("fields")
    if "global_transforms" in spec or isinstance(rules, Mapping):
        nested = isinstance(rules, Mapping) and all(
            isinstance(r, Mapping) and "type" not in r and all(isinstance(x, Mapping) for x in r.values())
            for r in rules.values()
        )
        if rules and nested and any("type" in x for r in rules.values() for x in r.values()):
            return {**spec, "fields": _table_entry(rules, table) or {}}
    return spec


# --- soft delete and the task ---------------------------------------------------------------


@dataclass(frozen=True)
class SoftDelete:
    field: str
    delete_values: Sequence[Any]
    on_cdc: bool = True
    on_full_sync: bool = True

    @staticmethod
    def parse(spec: "SoftDelete | Mapping[str, Any]") -> "SoftDelete":
        if isinstance(spec, SoftDelete):
            return spec
        return SoftDelete(
            field=spec["field"],
            delete_values=tuple(spec["delete_values"]),
            on_cdc=spec.get("handle_on_cdc", True),
            on_full_sync=spec.get("handle_on_full_sync", True),
        )


@dataclass(frozen=True)
class SyncTask:
    """What to read (``table``), what to do with each row, and where it goes (``index``).

    ``primary_key`` names document fields, as they are called after the task's own mapping.
    Options: ``batch_timeout_ms`` (time between micro-batches) and ``deduplicate`` (drop repeated
    deliveries within ``deduplicate_within``, ten minutes by default).
    """

    id: str
    table: str
    index: str
    primary_key: Sequence[str] = ("id",)
    source_name: str = "default"
    include: Sequence[str] | None = None
    exclude: Sequence[str] | None = None
    filter: EventFilter | None = None
    transform: Transforms | None = None
    mapping: FieldMap | None = None
    soft_delete: SoftDelete | None = None
    options: Mapping[str, Any] = field(default_factory=dict)

    @staticmethod
    def from_dict(spec: Mapping[str, Any]) -> "SyncTask":
        pk = spec.get("primary_key", "id")
        only = spec.get("field_filters") or {}

        def part(name: str, parser: Any) -> Any:
            value = _for_table(spec.get(name), spec["table"])
            return None if value is None else parser.parse(value)

        event_filter = part("filter", EventFilter)
        if only.get("expressions"):
            extra = tuple(Condition.parse(e) for e in only["expressions"])
            event_filter = event_filter or EventFilter()
            event_filter = replace(event_filter, conditions=(*event_filter.conditions, *extra))
        return SyncTask(
            id=spec["id"],
            table=spec["table"],
            index=spec["index"],
            primary_key=(pk,) if isinstance(pk, str) else tuple(pk),
            source_name=spec.get("source_name", "default"),
            include=only.get("include"),
            exclude=only.get("exclude"),
            filter=event_filter,
            transform=part("transform", Transforms),
            mapping=part("mapping", FieldMap),
            soft_delete=part("soft_delete", SoftDelete),
            options=dict(spec.get("options") or {}),
        )
