"""Change logs: text lines to rows, envelopes, positioned reads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.pgtypes import decode_scalar, infer_json, misfit, unquote
from driftline.functions.positions import lsn_number
from driftline.functions.values import quote_json
from driftline.operators import ERRORS, LSN, OLD, OP, SCHEMA, TABLE, UNCHANGED

# Shape of one text line of the log.
HEADER = r"^table\s+(?:([^:]*)\.)?([^.:]+):\s*(INSERT|UPDATE|DELETE):\s*"
FIELD = r"[^\s\[]++\[[^\[\]]*+(?:\[\][^\[\]]*+)*+\]:(?:'[^']*+(?:''[^']*+)*+'|\S*+)"
OLD_MARK, NEW_MARKS = "old-key:", ("new-tuple:", "new-key:")
LEFT_OUT = "unchanged-toast-datum"
# Fixed value: what stands for the fields of a delete whose table has no key.
NO_FIELDS = "(no-tuple-data)"
OTHER_OPERATION = r"^table\s+[^:]+:\s*[A-Z]+:"
UNDECODABLE, LEFT_OVER = "Cannot decode change line", "Cannot decode all fields of the change line"
OPS = {"INSERT": "create", "UPDATE": "update", "DELETE": "delete"}


def _name(token: Column) -> Column:
    return F.substring_index(token, "[", 1)


def _value(token: Column) -> Column:
    """``struct<type, raw>`` of one ``name[type]:raw`` token."""
    head = F.substring_index(token, "]:", 1)
    return F.struct(
        F.substring(head, F.length(_name(token)) + 2, F.length(head)).alias("type"),
        F.substring(token, F.length(head) + 3, F.length(token)).alias("raw"),
    )


def _to_map(df: DataFrame, tokens: str, result: str) -> DataFrame:
    """Tokens to a map by name; a name that repeats keeps its last value.

    One column per step, so that no step is computed twice.
    """
    names, values = F.col("__names"), F.col("__values")
    df = df.withColumns({"__names": F.transform(tokens, _name), "__values": F.transform(tokens, _value)})
    unique = F.size(F.array_distinct(names)) == F.size(names)
    entries = F.arrays_zip(names.alias("key"), values.alias("value"))
    last = F.filter(
        entries, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), e.getField("key"))
    )
    made = F.when(unique, F.map_from_arrays(names, values)).otherwise(F.map_from_entries(last))
    return df.withColumn(result, made).drop("__names", "__values", tokens)


def decode_lines(df: DataFrame, line: str = "data", keep_undecodable: bool = False) -> DataFrame:
    """Log lines to ``op, schema_name, table_name, fields, old_fields, decode_error`` next to the other columns.

    Fields are a map from name to ``struct<type, raw>``; see :func:`field_text`. Lines that are not
    row changes (BEGIN, COMMIT, other operations) give no row. The marks between the images of an
    update are tokens like the fields, so the same words inside a quoted value do not count. Text
    between the tokens is no field, and the row says so in ``decode_error``. Lines that start like a
    row change but have no readable header are left out, or kept with that error alone.
    """
    # The header is cut off once; what follows looks at that short text.
    text, head = F.col(line), F.col("__head")
    part = lambda i: F.regexp_extract(head, HEADER, i)
    ops = F.create_map(*[F.lit(x) for pair in OPS.items() for x in pair])
    others = [F.col(f"`{c}`") for c in df.columns if c != line]
    header = head != ""
    wanted = header | ~text.rlike(OTHER_OPERATION) if keep_undecodable else header
    pattern = "|".join([OLD_MARK, *NEW_MARKS, FIELD])
    rows = df.where(text.startswith("table ")).withColumn("__head", F.regexp_extract(text, HEADER, 0)).where(wanted).select(
        *others,
        F.when(~header, F.lit(UNDECODABLE)).alias("__no_header"),
        F.substring(text, F.length(head) + 1, F.length(text)).alias("__body"),
        F.try_element_at(ops, part(3)).alias("op"),
        F.when(header, F.coalesce(F.nullif(part(1), F.lit("")), F.lit("public"))).alias("schema_name"),
        F.when(header, part(2)).alias("table_name"),
    )
    tokens, mark, body = F.col("__tokens"), F.col("__mark"), F.col("__body")
    rows = rows.withColumn("__tokens", F.when(F.col("__no_header").isNull(), F.regexp_extract_all(body, F.lit(pattern), F.lit(0))))
    # Tokens that fill the body with single spaces between them leave nothing over.
    leftover = F.trim(F.regexp_replace(body, pattern, ""))
    filled = F.array_join(tokens, " ") == F.trim(body)
    rows = rows.withColumn(
        "decode_error", F.coalesce("__no_header", F.when(~filled & ~leftover.isin("", NO_FIELDS), F.lit(LEFT_OVER)))
    ).drop("__no_header", "__body")
    rows = rows.withColumn("__mark", F.greatest(*[F.array_position(tokens, m) for m in NEW_MARKS]).cast("int"))
    has_old = (mark > 1) & F.array_contains(tokens, OLD_MARK)
    new = F.when(mark > 0, F.slice(tokens, mark + 1, F.greatest(F.lit(0), F.size(tokens) - mark))).otherwise(tokens)
    old = F.when(has_old, F.slice(tokens, F.lit(1), mark - 1))
    rows = rows.withColumns(
        {"__new": F.array_remove(new, OLD_MARK), "__old": F.array_remove(old, OLD_MARK)}
    ).drop("__tokens", "__mark")
    return _to_map(_to_map(rows, "__new", "fields"), "__old", "old_fields")


def undecodable_lines(df: DataFrame, line: str = "data") -> DataFrame:
    """Lines that start like a row change but cannot be decoded; these belong in the dead letters."""
    text = F.col(line)
    lost = text.startswith("table ") & ~text.rlike(HEADER) & ~text.rlike(OTHER_OPERATION)
    return df.where(lost).withColumn("error", F.lit(UNDECODABLE))


def _text(raw: Column) -> Column:
    """Unquoted text; null for a bare ``null``."""
    return F.when(raw != "null", unquote(raw))


def field_text(fields: Column, name: str) -> Column:
    """Text of a field, null when it is null or not in the line."""
    return _text(F.try_element_at(fields, F.lit(name)).getField("raw"))


def unchanged_fields(fields: Column) -> Column:
    """Names of the fields whose value the line leaves out because it did not change."""
    return F.map_keys(F.map_filter(fields, lambda k, v: v.getField("raw") == LEFT_OUT))


def typed_fields(df: DataFrame, types: Mapping[str, str], fields: str = "fields", errors: str | None = None) -> DataFrame:
    """One column per entry of ``types`` (name to database type name); ``errors`` lists values that do not fit."""
    # Look every field up once, then unquote, then decode: each step uses its input several times.
    raw = {name: F.try_element_at(fields, F.lit(name)).getField("raw") for name in types}
    df = df.withColumns(raw)
    df = df.withColumns({name: _text(F.col(name)) for name in types})
    if errors is not None:
        cut = [F.when(misfit(F.col(n), kind), F.lit(f"Value of field {n} does not fit {kind}")) for n, kind in types.items()]
        df = df.withColumn(errors, F.array_compact(F.array(*cut)))
    return df.withColumns({name: decode_scalar(F.col(name), kind) for name, kind in types.items()})


def change_rows(
    df: DataFrame,
    types: Mapping[str, str],
    line: str = "data",
    lsn: str = "lsn",
    ts: str | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Log lines as rows a task takes: reserved columns and one typed column per entry of ``types``.

    ``__old`` holds the image before an update where the line has one. An update that changes one of
    ``keys`` also gives a delete of the old key. Lines that cannot be decoded as a whole, or have no
    (or no readable) position and cannot be ordered, carry their errors and their text in ``__line``
    and end as rejected rows; without a readable header they have no table.
    """
    rows = decode_lines(df.withColumn("__line", F.col(line)), line, keep_undecodable=True)
    rows = typed_fields(rows, types, errors="__misfits").withColumn(LSN, lsn_number(F.col(lsn)).try_cast("bigint"))
    before = {n: decode_scalar(field_text(F.col("old_fields"), n), kind).alias(n) for n, kind in types.items()}
    rows = rows.withColumn(OLD, F.when(F.col("old_fields").isNotNull(), F.struct(*before.values())))
    no_position = F.when(F.col(LSN).isNull(), F.lit("Missing position"))
    made = {
        SCHEMA: F.col("schema_name"),
        TABLE: F.col("table_name"),
        UNCHANGED: unchanged_fields(F.col("fields")),
        ERRORS: F.concat(F.array_compact(F.array(no_position, F.col("decode_error"))), "__misfits"),
    }
    if ts is not None:
        made["__ts"] = F.col(ts)
    rows = rows.withColumns(made).withColumn("__line", F.when(F.size(ERRORS) > 0, F.col("__line")))
    shown = [F.when(~F.coalesce(F.array_contains(UNCHANGED, n), F.lit(False)), F.col(n)).alias(n) for n in types]
    reserved = [SCHEMA, TABLE, LSN, UNCHANGED, OLD, *(["__ts"] if ts is not None else []), "__line", ERRORS]
    rows = rows.select(F.col("op").alias(OP), *reserved, *shown)
    if not keys:
        return rows
    old = {k: F.col(OLD).getField(k) for k in keys}
    moved = reduce(or_, [F.coalesce(v.isNotNull() & ~v.eqNullSafe(F.col(k)), F.lit(False)) for k, v in old.items()])
    moved = (F.col(OP) == "update") & (F.size(ERRORS) == 0) & moved
    images = F.when(moved, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    rows = rows.withColumn("__gone", F.explode(images))
    gone = F.col("__gone")
    nothing = F.array().cast("array<string>")
    return rows.select(
        F.when(gone, "delete").otherwise(F.col(OP)).alias(OP),
        *[F.when(gone, nothing).otherwise(F.col(c)).alias(c) if c == UNCHANGED else F.col(c) for c in reserved],
        *[F.when(gone, F.col(OLD).getField(n)).otherwise(F.col(n)).alias(n) for n in types],
    )


def inferred_json(fields: Column) -> Column:
    """Document text with untyped values inferred: quoted digits become numbers, blanks null."""

    def token(e: Column) -> Column:
        return F.concat(quote_json(e.getField("key")), F.lit(":"), infer_json(_text(e.getField("value").getField("raw"))))

    pairs = F.transform(F.map_entries(fields), token)
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


# --- envelopes ------------------------------------------------------------------------------


def envelope(df: DataFrame, data: str = "data", database: Column | None = None) -> DataFrame:
    """Change rows ``(op, schema_name, table_name, lsn, xid, ts, data)`` as nested events.

    The key is ``data.id``, else ``data._id``. Creates and updates fill ``new``, deletes ``old``.
    """
    image = df.schema[data].dataType
    candidates = [F.col(data).getField(n).cast("string") for n in ("id", "_id") if n in image.fieldNames()]
    key = F.coalesce(*candidates) if candidates else F.lit(None).cast("string")
    return df.select(
        F.col("op").alias("event_type"),
        F.struct(
            (F.lit("") if database is None else database).alias("database"),
            F.col("schema_name").alias("schema"),
            F.col("table_name").alias("table"),
        ).alias("source"),
        F.struct(
            key.alias("key"),
            F.when(F.col("op") == "delete", F.col(data)).alias("old"),
            F.when(F.col("op").isin("create", "update"), F.col(data)).alias("new"),
        ).alias("data"),
        F.struct(F.col("xid").cast("string").alias("transaction_id"), F.col("lsn").alias("position")).alias("metadata"),
        F.col("ts").alias("timestamp"),
    )


# Event type of each kind of stream row; control rows are stored as creates.
KIND_OP = {
    "insert": "create",
    "update": "update",
    "delete": "delete",
    "full_sync": "create",
    "checkpoint": "create",
    "heartbeat": "create",
}
CONTROL_KINDS = ("checkpoint", "heartbeat")


def stream_envelope(df: DataFrame) -> DataFrame:
    """Mixed stream rows ``(kind, op, schema_name, table_name, old, new)`` in one envelope shape.

    ``cdc`` rows keep their own op and schema and hold their image as ``new``; the other kinds
    belong to schema ``public``; control rows become ``system.control`` without images.
    """
    kind = F.col("kind")
    control = kind.isin(*CONTROL_KINDS)
    ops = F.create_map(*[F.lit(x) for pair in KIND_OP.items() for x in pair])
    new = F.when(kind.isin("cdc", "insert", "update", "full_sync"), F.col("new"))
    old = F.when(kind.isin("update", "delete"), F.col("old"))
    image = F.coalesce(new, old)
    key = image.getField("id").cast("string")
    return df.select(
        F.when(kind == "cdc", F.col("op")).otherwise(F.try_element_at(ops, kind)).alias("event_type"),
        F.when(control, "system").when(kind == "cdc", F.col("schema_name")).otherwise("public").alias("schema"),
        F.when(control, "control").otherwise(F.col("table_name")).alias("table"),
        F.when(~control, key).alias("key"),
        F.when(~control, old).alias("old"),
        F.when(~control, new).alias("new"),
    )


# --- positions ------------------------------------------------------------------------------


def after(df: DataFrame, start: int, lsn: str = "lsn_num") -> DataFrame:
    """Rows after a position: a plain comparison, so files with smaller maxima are skipped."""
    return df.where(F.col(lsn) > F.lit(start))


def replay(
    df: DataFrame, from_lsn: int, to_lsn: int, limit: int | None = None, lsn: str = "lsn_num", table: str = "table_name"
) -> DataFrame:
    """Rows of a position range, oldest first when cut at ``limit``."""
    rows = df.where(F.col(lsn).between(from_lsn, to_lsn))
    return rows if limit is None else rows.orderBy(lsn, table).limit(limit)


def replay_plan(df: DataFrame, from_lsn: int, to_lsn: int, lsn: str = "lsn_num", table: str = "table_name") -> DataFrame:
    """What a replay of the range would touch, per table."""
    return (
        replay(df, from_lsn, to_lsn, lsn=lsn, table=table)
        .groupBy(table)
        .agg(F.count(F.lit(1)).alias("events"), F.min(lsn).alias("first_lsn"), F.max(lsn).alias("last_lsn"))
    )
