"""Dead letters as a keyed table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import LSN, OP, deadletters
from driftline.sources.keyed_table import KeyedTable


# Writer name of edits that are made by hand, beside those of streams.
EDITS = "edits"


class DeadLetterTable:
    def __init__(self, spark: SparkSession, path: str):
        self.table = KeyedTable(spark, path, ["id"], deadletters.ENTRY_SCHEMA)

    def _next(self) -> int:
        return self.table.last_batch() + 1

    def read(self) -> DataFrame:
        return self.table.current()

    def get(self, entry_id: str) -> DataFrame:
        return self.read().where(F.col("id") == entry_id)

    def store(self, entries: DataFrame, batch_id: int | None = None, writer: str = EDITS) -> None:
        """Add entries, or replace those with the same id."""
        self.table.upsert(entries, self._next() if batch_id is None else batch_id, writer)

    update = store

    def remove(self, entries: DataFrame) -> None:
        self._settle(entries.withColumn(OP, F.lit("delete")))

    def _settle(self, entries: DataFrame) -> None:
        """One batch of edits, each with its ``__op``."""
        number = self._next()
        place = self.table.place_of(number, EDITS)
        self.table.write_batch(entries.withColumn(LSN, F.lit(place).cast("bigint")), number, EDITS)

    def clear_task(self, task_id: str) -> int:
        """Remove all entries of a task; returns how many there were."""
        entries = deadletters.by_task(self.read(), task_id)
        removed = entries.count()
        if removed:
            self.remove(entries)
        return removed

    def take_for_retry(
        self, task_id: str, limit: int, at: Column, send: Callable[[DataFrame], DataFrame | None] | None = None
    ) -> DataFrame:
        """Oldest entries of a task, counted as retried and taken out of the table.

        ``send`` hands them on and returns the entries that failed again, if any. Only when it has
        come back are the others removed and the failed ones stored, in one batch: if it fails,
        the table is as it was. The returned rows are read from the files as they were before, so
        they stay readable.
        """
        picked = deadletters.by_task(self.read(), task_id, limit)
        tried = deadletters.retry(picked, at)
        failed = send(tried) if send else None
        edits = picked.withColumn(OP, F.lit("delete"))
        if failed is not None:
            again = failed.select(*picked.columns).withColumn(OP, F.lit("update"))
            edits = deadletters.without(edits, again).unionByName(again)
        self._settle(edits)
        return tried

    def retain(self, max_entries: int, now: Column, hours: int | None = None) -> None:
        """Take out all entries that are too old or beyond the newest ``max_entries``."""
        everything = self.read()
        kept = deadletters.retained(everything, max_entries, now, hours)
        self.remove(deadletters.without(everything, kept))
