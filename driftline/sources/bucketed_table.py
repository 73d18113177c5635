"""A keyed table as a bucketed, partitioned table of the catalogue that is merged in place.

Rows lie in ``parts`` partitions by a hash of their key, and in ``buckets`` buckets by key within each.
A batch touches the partitions its keys hash to: only these are read, and only these are written
again (dynamic partition overwrite). Buckets give the scan the distribution the merge needs, so the
table's rows are not shuffled; the batch is, into as many tasks as there are buckets.

Applying a batch costs as much as the partitions it touches, reading costs nothing extra: there is
nothing to fold. That suits tables that are read often, with batches that touch a share of
the partitions. For tiny batches all over a large table :class:`KeyedTable` writes less.

Every row keeps the position of its last change. A batch that is run again, or rows that were
delivered before, change nothing; a deleted key has no row and so no position. Spark moves the
partitions of a batch into place one after another, so a reader in between may see some of them
before the others; the catalogue's table formats with MERGE do better where they are at hand.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.operators import LSN, OP, UNCHANGED
from driftline.operators.merge import fold_unchanged, latest_per_key

PART = "__part"

# Partitions a table is cut into, and buckets (tasks of a merge) within each.
PARTS, BUCKETS = 64, 16


class BucketedTable:
    def __init__(
        self,
        spark: SparkSession,
        name: str,
        keys: Sequence[str],
        schema: T.StructType | str,
        path: str | None = None,
        parts: int = PARTS,
        buckets: int = BUCKETS,
        unchanged: bool = False,
    ):
        """``schema`` is that of the rows, without the reserved columns. ``path`` makes the table an external one."""
        if isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        self.spark, self.name, self.keys, self.schema, self.path = spark, name, list(keys), schema, path
        self.parts, self.buckets, self.unchanged = parts, buckets, unchanged

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.parts)).cast("int").alias(PART)

    def _columns(self) -> list[str]:
        return [*self.schema.fieldNames(), LSN]

    # --- writing ----------------------------------------------------------------------------

    def write_base(self, df: DataFrame, version: int = 0) -> None:
        """Store a full copy, as of position ``version``."""
        rows = df.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema.fields], F.lit(version).cast("bigint").alias(LSN))
        # A task per bucket, so that a partition gets one file of each.
        rows = rows.withColumn(PART, self._part()).repartition(self.buckets, *self.keys)
        writer = rows.write.format("parquet").mode("overwrite").partitionBy(PART).bucketBy(self.buckets, *self.keys).sortBy(*self.keys)
        if self.path:
            writer = writer.option("path", self.path)
        writer.saveAsTable(self.name)

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def touched(self, latest: DataFrame) -> list[int]:
        """The partitions a batch touches, ``parts`` numbers at most."""
        return sorted(r[0] for r in latest.select(self._part()).distinct().collect())

    def merged(self, latest: DataFrame, parts: Sequence[int]) -> DataFrame:
        """Rows of ``parts`` after one change per key. The table's side is read by bucket and not shuffled."""
        fields = self.schema.fieldNames()
        own = [c for c in fields if c not in self.keys]
        base = latest.sparkSession.table(self.name).where(F.col(PART).isin(list(parts)))
        before = base.select(*self.keys, F.struct(F.col(LSN).alias("lsn"), *own).alias("__before"))
        left_out = F.col(UNCHANGED) if self.unchanged else F.lit(None).cast("array<string>")
        after = latest.select(*self.keys, F.struct(F.col(OP).alias("op"), F.col(LSN).alias("lsn"), left_out.alias("left_out"), *own).alias("__after"))
        # Dealt out as the buckets are, or the planner could choose to shuffle the table instead.
        rows = before.join(after.repartition(self.buckets, *self.keys), self.keys, "full_outer")
        newer = F.col("__after").isNotNull() & (F.col("__before").isNull() | (F.col("__after.lsn") >= F.col("__before.lsn")))

        def value(name: str) -> Column:
            old, new = F.col("__before").getField(name), F.col("__after").getField(name)
            if self.unchanged and name in own:
                new = F.when(F.coalesce(F.array_contains("__after.left_out", name), F.lit(False)), old).otherwise(new)
            return F.when(newer, new).otherwise(old).alias(LSN if name == "lsn" else name)

        rows = rows.withColumn("__newer", F.coalesce(newer, F.lit(False)))
        rows = rows.where(~F.col("__newer") | (F.col("__after.op") != "delete"))
        columns = [F.col(f"`{c}`") if c in self.keys else value(c) for c in fields]
        return rows.select(*columns, value("lsn"), self._part())

    def merge(self, changes: DataFrame) -> list[int]:
        """Apply a batch (rows plus ``__op`` and ``__lsn``); returns the partitions that were written.

        A row without a key cannot be found again and ends the merge.
        """
        if not self.exists():
            self.write_base(self.spark.createDataFrame([], self.schema))
        wanted = changes.where(F.col(OP).isin("create", "update", "delete"))
        if self.unchanged and UNCHANGED not in wanted.columns:
            wanted = wanted.withColumn(UNCHANGED, F.array().cast("array<string>"))
        keyless = reduce(or_, [F.col(f"`{k}`").isNull() for k in self.keys])
        checked = F.when(keyless, F.raise_error(F.lit("change without a key"))).otherwise(F.lit(True))
        reserved = [F.col(OP), F.col(LSN).cast("bigint").alias(LSN), *([F.col(UNCHANGED)] if self.unchanged else [])]
        wanted = wanted.where(checked).select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema.fields], *reserved)
        # The batch is read twice, for its partitions and for the merge; lost blocks are computed again.
        latest = self._last(wanted).persist()
        try:
            parts = self.touched(latest)
            if parts:
                written = Observation()
                rows = self.merged(latest, parts).observe(written, *[F.coalesce(F.bool_or(F.col(PART) == p), F.lit(False)).alias(f"p{p}") for p in parts])
                self._overwrite(rows)
                for p in parts:
                    if not written.get[f"p{p}"]:
                        self._clear(latest.sparkSession, p)
            return parts
        finally:
            latest.unpersist()

    def _last(self, changes: DataFrame) -> DataFrame:
        if self.unchanged:
            return fold_unchanged(changes, self.keys, LSN, [c for c in self.schema.fieldNames() if c not in self.keys])
        return latest_per_key(changes, self.keys, [LSN])

    def _overwrite(self, rows: DataFrame) -> None:
        """Replace the partitions that ``rows`` has, and no others; they move into place after all are written."""
        conf, mode = rows.sparkSession.conf, "spark.sql.sources.partitionOverwriteMode"
        before = conf.get(mode)
        conf.set(mode, "dynamic")
        try:
            rows.select(*self._columns(), PART).write.mode("overwrite").insertInto(self.name)
        finally:
            conf.set(mode, before)

    def _clear(self, spark: SparkSession, part: int) -> None:
        """Empty a partition whose last row was deleted: overwriting by partition cannot tell."""
        none = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`" for f in [*self.schema.fields, T.StructField(LSN, T.LongType())])
        spark.sql(f"INSERT OVERWRITE TABLE `{self.name}` PARTITION (`{PART}` = {part}) SELECT {none} WHERE false")

    # --- as a target of tasks and streams -----------------------------------------------------

    def place_of(self, batch_id: int, writer: str | None = None) -> int:
        return batch_id

    def compact_every(self, batches: int | None, before: int) -> None:
        """Nothing to fold."""

    def write_batch(self, changes: DataFrame, batch_id: int, writer: str | None = None) -> None:
        self.merge(changes)

    # --- reading ----------------------------------------------------------------------------

    def current(self) -> DataFrame:
        return self.spark.table(self.name).select(*self.schema.fieldNames())
