"""A keyed table kept as a base version plus batches of changes, all plain files.

    <path>/base/v=<n>                       rows as of place n
    <path>/folded/v=<n>                     names of the batches that base holds
    <path>/changes/batch=<n>                last change per key of batch n
    <path>/changes/batch=<n>.<writer>.<i>   the same for batch i of a named writer, at place n

A batch writes only its own changes and reading merges them, so applying a batch costs as much as
the batch, not as the table. ``compact`` folds the batches into a new base now and then. Several
writers (streams, an operator who edits) share a table: a writer's batch takes the next free place
when it is first written and keeps it, so running it again (a stream does that after a failure)
replaces its own rows and nobody else's. A base lists the batches it folded; any other batch is
still to be merged, wherever its place is. Directories without a success mark (a job that died)
are not read. New batches and new bases leave all earlier files alone, so a reader keeps the set
it started with. Where a table format with MERGE is at hand, that is the better home.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.operators import LSN, OP, UNCHANGED
from driftline.operators.merge import fill_unchanged, fold_unchanged, latest_per_key, merge_snapshot


# Batches are folded once they are this share of the base, or this many times the usual number.
FOLD_SHARE, MOST_BATCHES = 0.1, 10


def _place(name: str) -> int:
    return int(name.partition(".")[0])


class KeyedTable:
    def __init__(
        self, spark: SparkSession, path: str, keys: Sequence[str], schema: T.StructType | str, unchanged: bool = False
    ):
        """``schema`` is that of the rows, without the reserved columns.

        With ``unchanged``, changes may name fields they leave out in ``__unchanged``: these keep the
        newest value known from earlier changes or the base. It costs a join with the base when
        reading.
        """
        if isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        self.spark, self.path, self.keys, self.schema = spark, path.rstrip("/"), list(keys), schema
        self.unchanged = unchanged
        reserved = [T.StructField(OP, T.StringType()), T.StructField(LSN, T.LongType())]
        if unchanged:
            reserved.append(T.StructField(UNCHANGED, T.ArrayType(T.StringType())))
        self.change_schema = T.StructType([*schema.fields, *reserved])

    # --- files ------------------------------------------------------------------------------

    def _named(self, kind: str, prefix: str, mark: str = "/_SUCCESS") -> list[str]:
        """Names of the directories of a kind, without their prefix; with a success mark unless told otherwise."""
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{prefix}*{mark}")
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
        paths = [s.getPath().getParent() if mark else s.getPath() for s in found]
        return [p.getName()[len(prefix) :] for p in paths]

    def version(self) -> int:
        """Place of the newest base; -1 before the first."""
        listed = set(self._named("folded", "v="))
        return max((int(v) for v in self._named("base", "v=") if v in listed), default=-1)

    def last_batch(self) -> int:
        return max([self.version(), *map(_place, self._named("changes", "batch="))])

    def batch_names(self) -> list[str]:
        """Names of all finished batches."""
        return sorted(self._named("changes", "batch="))

    def place_of(self, batch_id: int, writer: str | None = None) -> int:
        """Where a batch stands among all batches: its number, or for a named writer the place it has or gets."""
        if writer is None:
            return batch_id
        taken = self._named("changes", "batch=", mark="")
        own = [_place(n) for n in taken if n.partition(".")[2] == f"{writer}.{batch_id}"]
        return min(own) if own else 1 + max([0, self.version(), *map(_place, taken)])

    def _unfolded(self, until: int | None) -> list[str]:
        """Names of the finished batches that the newest base does not hold."""
        version = self.version()
        folded = set()
        if version >= 0:
            folded = {r[0] for r in self.spark.read.text(f"{self.path}/folded/v={version}").collect()}
        names = [n for n in self._named("changes", "batch=") if n not in folded]
        return sorted((n for n in names if until is None or _place(n) <= until), key=lambda n: (_place(n), n))

    def _read(self, paths: list[str], schema: T.StructType) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    # --- writing ----------------------------------------------------------------------------

    def write_base(self, df: DataFrame, version: int = 0, folded: Sequence[str] = ()) -> None:
        """Store a full copy as of place ``version``, which holds the batches ``folded``."""
        df.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/base/v={version}")
        names = self.spark.createDataFrame([(n,) for n in folded], "value string").coalesce(1)
        names.write.mode("overwrite").text(f"{self.path}/folded/v={version}")

    def write_batch(self, changes: DataFrame, batch_id: int, writer: str | None = None) -> None:
        """Store the last change per key. ``changes`` has the rows plus ``__op`` and ``__lsn``.

        A row without a key cannot be found again and ends the write; tasks reject such rows before.
        """
        if self.unchanged and UNCHANGED not in changes.columns:
            changes = changes.withColumn(UNCHANGED, F.array())
        place = self.place_of(batch_id, writer)
        wanted = changes.select(*[F.col(f.name).cast(f.dataType) for f in self.change_schema.fields])
        keyless = reduce(or_, [F.col(f"`{k}`").isNull() for k in self.keys])
        checked = F.when(keyless, F.raise_error(F.lit("change without a key"))).otherwise(F.lit(True))
        rows = self._last(wanted.where(F.col(OP).isin("create", "update", "delete")).where(checked))
        name = f"{place}" if writer is None else f"{place}.{writer}.{batch_id}"
        rows.select(*self.change_schema.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/changes/batch={name}")

    def _last(self, changes: DataFrame) -> DataFrame:
        if self.unchanged:
            columns = [c for c in self.schema.fieldNames() if c not in self.keys]
            return fold_unchanged(changes, self.keys, LSN, columns)
        return latest_per_key(changes, self.keys, [LSN])

    def upsert(self, rows: DataFrame, batch_id: int, writer: str | None = None) -> None:
        place = self.place_of(batch_id, writer)
        self.write_batch(rows.withColumns({OP: F.lit("update"), LSN: F.lit(place).cast("bigint")}), batch_id, writer)

    def compact(self, until: int | None = None) -> int:
        """Fold finished batches (up to place ``until``) into a new base; returns its version."""
        names = self._unfolded(until)
        if not names:
            return self.version()
        version = max(_place(names[-1]), self.version() + 1)
        earlier = set(self._named("changes", "batch=")) - set(self._unfolded(None))
        self.write_base(self._merged(names), version, sorted(earlier | set(names)))
        return version

    def _bytes(self, paths: Sequence[str]) -> int:
        total = 0
        for name in paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            total += path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
        return total

    def compact_every(self, batches: int | None, before: int) -> None:
        """Called ahead of place ``before``: fold what came earlier once enough has piled up.

        That is ``batches`` batches which together are a fair share of the base, so that a large
        base is not written again for small changes; or so many that reading them costs more.
        """
        names = self._unfolded(before - 1) if batches else []
        if not names or len(names) < batches:
            return
        version = self.version()
        base = self._bytes([f"base/v={version}"]) if version >= 0 else 0
        if len(names) >= MOST_BATCHES * batches or self._bytes([f"changes/batch={n}" for n in names]) >= FOLD_SHARE * base:
            self.compact(until=before - 1)

    # --- reading ----------------------------------------------------------------------------

    def base(self) -> DataFrame:
        version = self.version()
        return self._read([f"{self.path}/base/v={version}"] if version >= 0 else [], self.schema)

    def _changes(self, names: Sequence[str]) -> DataFrame:
        return self._read([f"{self.path}/changes/batch={n}" for n in names], self.change_schema)

    def changes(self, until: int | None = None) -> DataFrame:
        """All changes the base does not hold, up to and including place ``until``."""
        return self._changes(self._unfolded(until))

    def _merged(self, names: Sequence[str]) -> DataFrame:
        base, latest = self.base(), self._last(self._changes(names))
        if self.unchanged:
            latest = fill_unchanged(latest, base, self.keys)
        return merge_snapshot(base, latest.drop(LSN), self.keys).select(*self.schema.fieldNames())

    def as_of(self, batch: int | None) -> DataFrame:
        """Rows after place ``batch``, so a batch that is run again does not see itself.

        Only batches that the newest base does not hold can be told apart.
        """
        return self._merged(self._unfolded(batch))

    def current(self) -> DataFrame:
        return self.as_of(None)

    def publish_version(self, view: str) -> int:
        """Fold everything and point a view of the catalogue at the new base; returns its version.

        The view is replaced in one step and every session of the catalogue sees it.
        """
        version = self.compact()
        columns = ", ".join(f"`{c}`" for c in self.schema.fieldNames())
        self.spark.sql(f"CREATE OR REPLACE VIEW `{view}` AS SELECT {columns} FROM parquet.`{self.path}/base/v={version}`")
        return version

    def publish(self, view: str) -> DataFrame:
        """Point a view of this session at the current state; readers of the earlier plan keep their files."""
        df = self.current()
        df.createOrReplaceTempView(view)
        return df
