"""One sync task as a chain of DataFrame steps."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.config import SyncTask
from driftline.operators import ERRORS, OP, conditions, fields, is_meta, softdelete

DEFAULT_ORDER = ("filter", "soft_delete", "transform", "map")


@dataclass(frozen=True)
class Outcome:
    """Rows a task accepts, and rows it rejects with their errors.

    Both are branches of one plan. A caller that runs both over an expensive input should
    persist ``all_rows`` or write it once.
    """

    all_rows: DataFrame

    @property
    def accepted(self) -> DataFrame:
        if ERRORS not in self.all_rows.columns:
            return self.all_rows
        return self.all_rows.where(F.size(ERRORS) == 0).drop(ERRORS)

    @property
    def rejected(self) -> DataFrame:
        """Failed rows: reserved columns, the row as JSON (``event``) and ``error``.

        A row that still has its log line (``__line``) shows that as ``event``.
        """
        rows = self.all_rows
        if ERRORS not in rows.columns:
            rows = rows.withColumn(ERRORS, F.array().cast("array<string>"))
        doc = [F.col(f"`{c}`") for c in rows.columns if not is_meta(c)]
        meta = [c for c in rows.columns if is_meta(c) and c != ERRORS]
        event = F.to_json(F.struct(*doc), {"ignoreNullFields": "false"})
        if "__line" in rows.columns:
            line = F.to_json(F.struct(F.col("__line").alias("line")))
            event = F.when(F.col("__line").isNotNull(), line).otherwise(event)
        return rows.where(F.size(ERRORS) > 0).select(
            *meta,
            event.alias("event"),
            F.array_join(ERRORS, "\n").alias("error"),
        )


def run_task(
    df: DataFrame,
    task: SyncTask,
    full_sync: bool = False,
    clock: Column | None = None,
    order: Sequence[str] = DEFAULT_ORDER,
    stages: Sequence[Callable[[DataFrame], DataFrame]] = (),
) -> Outcome:
    """Filter, soft delete, transform and map the rows of one table.

    ``stages`` are the user's own ``DataFrame -> DataFrame`` steps, run last. ``order`` is the
    order of the built-in steps: the default looks for the soft-delete marker under its source
    name.
    """
    if not full_sync and OP not in df.columns:
        raise ValueError(f"change rows need the column {OP}")
    df = fields.select_fields(df, task.include, task.exclude)

    def soft_delete(rows: DataFrame) -> DataFrame:
        step = softdelete.soft_delete_rows if full_sync else softdelete.soft_delete_changes
        return step(rows, task.soft_delete)

    steps: dict[str, tuple[object, Callable[[DataFrame], DataFrame]]] = {
        "filter": (task.filter, lambda rows: conditions.filter_events(rows, task.filter)),
        "soft_delete": (task.soft_delete, soft_delete),
        "transform": (task.transform, lambda rows: fields.transform(rows, task.transform, full_sync, clock)),
        "map": (task.mapping, lambda rows: fields.map_fields(rows, task.mapping)),
    }
    for name in order:
        configured, step = steps[name]
        if configured is not None:
            df = df.transform(step)
    for stage in stages:
        df = df.transform(stage)
    return Outcome(df)
