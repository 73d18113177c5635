"""Changes onto a keyed snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.values import INTEGRAL
from driftline.operators import OP, UNCHANGED, is_meta
from driftline.operators.topk import first_per_key


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last change of every key."""
    return first_per_key(df, keys, [F.col(o).desc() for o in order], 1)


def document_actions(df: DataFrame, primary_key: str | None, op: str = OP) -> DataFrame:
    """What a change does to the index: ``action``, ``doc_id`` and ``error``.

    Creates and updates write the whole document. Deletes need a text or integer key: other key
    types and null keys are skipped, a missing key field is an error. Truncate and schema changes
    are skipped.
    """
    delete = F.col(op) == "delete"
    present = primary_key is not None and primary_key in df.columns
    doc_id: Column = F.lit(None).cast("string")
    if present and isinstance(df.schema[primary_key].dataType, (T.StringType, *INTEGRAL)):
        doc_id = F.col(primary_key).cast("string")
    if primary_key is None:
        error = F.when(delete, F.lit("A delete needs a primary key, and the task names none"))
    elif not present:
        error = F.when(delete, F.lit(f"The deleted row has no field '{primary_key}' to find it by"))
    else:
        error = F.lit(None).cast("string")
    action = (
        F.when(F.col(op).isin("create", "update"), "upsert")
        .when(delete & error.isNotNull(), "error")
        .when(delete & doc_id.isNotNull(), "delete")
        .otherwise("skip")
    )
    return df.withColumns({"action": action, "doc_id": doc_id, "error": error})


def fold_unchanged(
    changes: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], unchanged: str = UNCHANGED
) -> DataFrame:
    """Last change per key in which columns marked as unchanged hold their newest known value.

    ``unchanged`` is an array column with the names a change left out. A column that no change of
    the batch knows stays listed, for :func:`merge_snapshot` to fill from the snapshot.
    """
    named = lambda c: F.coalesce(F.array_contains(unchanged, c), F.lit(False))
    known = {c: F.max_by(F.struct(F.col(c).alias("v")), F.when(~named(c), F.col(order))) for c in columns}
    others = [c for c in changes.columns if c not in {*keys, *columns, unchanged}]
    folded = changes.groupBy(*keys).agg(
        F.max_by(F.struct(*others), order).alias("__row"), *[k.alias(f"__k_{c}") for c, k in known.items()]
    )
    missing = F.array_compact(F.array(*[F.when(F.col(f"__k_{c}").isNull(), F.lit(c)) for c in columns]))
    return folded.select(
        *keys,
        *[F.col("__row").getField(c).alias(c) for c in others],
        *[F.col(f"__k_{c}").getField("v").alias(c) for c in columns],
        missing.alias(unchanged),
    )


def fill_unchanged(latest: DataFrame, snapshot: DataFrame, keys: Sequence[str], unchanged: str = UNCHANGED) -> DataFrame:
    """Take columns still marked as unchanged from the snapshot row of the same key."""
    shared = [c for c in snapshot.columns if c in latest.columns and c not in keys]
    before = snapshot.select(*keys, F.struct(*shared).alias("__before"))
    joined = latest.join(before, list(keys), "left")
    filled = {
        c: F.when(F.array_contains(unchanged, c), F.col("__before").getField(c)).otherwise(F.col(c)) for c in shared
    }
    return joined.withColumns(filled).drop("__before", unchanged)


def merge_snapshot(snapshot: DataFrame, latest: DataFrame, keys: Sequence[str], op: str = OP) -> DataFrame:
    """Snapshot after one change per key: changed keys leave, live changes replace them.

    ``latest`` must hold one row per key. Only the keys of the snapshot side meet the join; when
    the changes are few the planner broadcasts them by their measured size and the snapshot is
    not shuffled.
    """
    untouched = snapshot.join(latest.select(*keys), list(keys), "left_anti")
    drop = [c for c in latest.columns if is_meta(c) or c == op]
    live = latest.where(~F.col(op).isin("delete", "truncate", "schema")).drop(*drop)
    return untouched.unionByName(live, allowMissingColumns=True)


def fan_in(snapshot: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str], op: str = OP) -> DataFrame:
    """Compact a log and apply it to a snapshot with one row per key, reading each once.

    One outer join tells untouched, replaced, new and deleted rows apart. The compacted log is
    already spread by key, so only the snapshot is shuffled for it. For few changes next to a large
    snapshot :func:`merge_snapshot` is the cheaper one: it can leave the snapshot where it is.
    """
    rows = changes.where(F.col(op).isin("create", "update", "delete"))
    latest = latest_per_key(rows, keys, order).drop(*order)
    fields = [c for c in latest.columns if c not in keys and c != op and not is_meta(c)]
    own = [c for c in snapshot.columns if c not in keys]
    after = latest.select(*keys, F.struct(F.col(op).alias("op"), *fields).alias("__after"))
    before = snapshot.select(*keys, F.struct(F.lit(1).alias("is"), *own).alias("__before"))
    joined = before.join(after, list(keys), "full_outer")
    changed = F.col("__after").isNotNull()
    merged = joined.where(~changed | (F.col("__after.op") != "delete"))
    columns = []
    for c in [*own, *[f for f in fields if f not in own]]:
        new = F.col("__after").getField(c) if c in fields else F.lit(None)
        old = F.col("__before").getField(c) if c in own else F.lit(None)
        columns.append(F.when(changed, new).otherwise(old).alias(c))
    return merged.select(*keys, *columns).select(*snapshot.columns, *[f for f in fields if f not in own])
