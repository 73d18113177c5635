"""Running state per key in the engine's state store: streaks, last outcomes, conditions that hold.

State lives in RocksDB beside the stream's checkpoint, so a micro-batch reads and writes the state
of its own keys only, a restart goes on from the last finished batch, and no state table is read.
Streaks keep their keys in buckets, one state and one Python call each: a call costs milliseconds, a
key in it microseconds, and a micro-batch reads and writes the buckets of its keys.
Each operator emits the new state of the keys a batch has touched; what follows keeps the newest.

Rows of a key within a batch are sorted by position before they count, so their order in the files
does not matter. Batches are expected in log order: rows at or before the position a key has reached
(repeated ones, or a file that lands behind its successor) change nothing but the counter ``repeated``. A batch's rows of one key meet in one task as arrays of a few numbers each; the
reader's ``max_files`` or ``max_bytes`` bounds them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Outcomes a key keeps; the mean of the last so many is reported.
RECENT = 10


def use_rocksdb(spark: SparkSession) -> None:
    """State of many keys, values and timers needs this store; streams started from here on use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


# Buckets that keys are dealt to; the store holds one state per bucket.
BUCKETS = 1024

# What the store holds of a bucket: its keys with their runs, repeated rows and last outcomes, as an Arrow stream.
BUCKET_STATE = "held binary"


def _packed(held: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, held.schema) as out:
        out.write_table(held)
    return sink.getvalue().to_pybytes()


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each key's share of ``values``, which lie key by key."""
    begin, sums = np.cumsum(counts) - counts, np.zeros(len(counts))
    for n in np.unique(counts[counts > 0]):
        of = np.flatnonzero(counts == n)
        sums[of] = values[begin[of, None] + np.arange(n)].sum(axis=1)
    return sums


def streak_step(keys: Sequence[str], recent: int, idle: int | None) -> Callable[..., Iterator[pd.DataFrame]]:
    """A batch's rows of one bucket of keys onto the bucket's state, all keys at once.

    The bucket's timeout is the end of the earliest silence; whichever call sees the watermark past a
    silence first, ends that run.
    """

    def step(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        found = [] if state.hasTimedOut else [r.iloc[:, 1 : len(keys) + 5] for r in parts if len(r)]
        named = [r.set_axis([*keys, "position", "ok", "at", "value"], axis=1) for r in found]
        held = pa.ipc.open_stream(state.get[0]).read_all() if state.exists else None
        frames = [*([held.select(keys).to_pandas()] if held is not None else []), *[r[list(keys)] for r in named]]
        known, old = pd.concat(frames, ignore_index=True), 0 if held is None else len(held)
        # Numbers in order of appearance: the held keys have their places.
        number = known.groupby(list(keys), sort=False, dropna=False).ngroup().to_numpy()
        n = int(number.max()) + 1
        known = known[~pd.Series(number).duplicated().to_numpy()]

        def start(name: str, kind: type) -> np.ndarray:
            before = held[name].to_numpy().astype(kind) if held is not None else np.zeros(0, kind)
            return np.concatenate([before, np.zeros(n - old, kind)])

        run_ok, length, reached = start("ok", bool), start("length", np.int64), start("position", np.int64)
        until, repeated = start("at", np.int64), start("repeated", np.int64)
        touched, renewed = np.zeros(n, bool), np.zeros(n, bool)
        last = held["last"].combine_chunks() if held is not None else pa.array([], pa.list_(pa.float64()))
        counts = np.concatenate([last.value_lengths().to_numpy().astype(np.int64), np.zeros(n - old, np.int64)])
        values = last.flatten().to_numpy()
        if named:
            position, ok, at, value = (np.concatenate([r[c].to_numpy() for r in named]) for c in ("position", "ok", "at", "value"))
            own = number[old:]
            order = np.lexsort((position, own))
            own, position, ok, at, value = own[order], position[order], ok[order].astype(bool), at[order], value[order]
            touched[own] = True
            fresh = np.concatenate(([True], (own[1:] != own[:-1]) | (np.diff(position) > 0)))
            fresh &= (own >= old) | (position > reached[own])
            repeated += np.bincount(own[~fresh], minlength=n)
            own, position, ok, at, value = own[fresh], position[fresh], ok[fresh], at[fresh], value[fresh]
        if named and len(own):
            first = np.concatenate(([True], own[1:] != own[:-1]))
            begins = first.copy()
            begins[1:] |= ok[1:] != ok[:-1]
            if idle is not None:
                begins[1:] |= np.diff(at) > idle
            ends = np.flatnonzero(np.concatenate((first[1:], [True])))
            if np.isnan(position[ends]).any() or np.isnan(at[ends]).any():
                raise ValueError("a row without position or time")
            places, k = np.flatnonzero(first), own[ends]
            began = np.maximum.accumulate(np.where(begins, np.arange(len(own)), 0))[ends]
            # A run that began before this batch goes on unless it is over.
            goes_on = (began == places) & (k < old) & (run_ok[k] == ok[places])
            if idle is not None:
                goes_on &= ~(at[places] - until[k] > idle)
            length[k] = ends - began + 1 + np.where(goes_on, length[k], 0)
            run_ok[k], reached[k], until[k], renewed[k] = ok[ends], position[ends], at[ends], True
            owner = np.concatenate([np.repeat(np.arange(n), counts), own])
            order = np.argsort(owner, kind="stable")
            owner, values = owner[order], np.concatenate([values, value])[order]
            counts = np.bincount(owner, minlength=n)
            kept = np.cumsum(counts)[owner] - np.arange(len(owner)) <= recent
            values, counts = values[kept], np.minimum(counts, recent)
        silent = np.zeros(n, bool)
        if idle is not None:
            # Positions of silent keys stay, so that repeated rows are still known.
            now = state.getCurrentWatermarkMs()
            silent = ~renewed & (length > 0) & (until + idle <= now)
            length[silent] = 0
        runs = {"ok": run_ok, "length": length, "position": reached, "repeated": repeated}
        offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        after = pa.Table.from_pandas(known.assign(**runs, at=until), preserve_index=False)
        state.update((_packed(after.append_column("last", pa.ListArray.from_arrays(offsets, values))),))
        if idle is not None and (length > 0).any():
            # A timeout is over once the watermark is past it, a silence when the watermark reaches its end.
            state.setTimeoutTimestamp(max(int(until[length > 0].min()) + idle - 1, now + 1))
        shown = known.assign(**runs, recent_rows=counts, recent_sum=_sums(values, counts), silent=silent)
        yield shown[touched | silent]

    return step


def streaks(
    stream: DataFrame,
    keys: Sequence[str],
    order: str,
    success: Column,
    value: Column | None = None,
    recent: int = RECENT,
    ts: str | None = None,
    idle_seconds: int | None = None,
    delay: str = "0 seconds",
    buckets: int = BUCKETS,
) -> DataFrame:
    """The run of equal outcomes each key is in, after every batch, in update mode.

    Columns are the keys, ``ok`` and ``length`` of the run, the last ``position``, number and sum of the
    last ``recent`` values, the number of ``repeated`` rows (at or before the position reached), and whether the key
    is ``silent``. A success that is null counts as failure. With ``ts`` and ``idle_seconds`` a silence longer
    than that ends a run: a later row begins a new one, and when the watermark passes the end of the
    silence a timeout reports the key with length 0. The number of ``buckets`` belongs to the checkpoint, like
    that of the shuffle partitions.
    """
    if idle_seconds is not None and ts is None:
        raise ValueError("idle_seconds needs a time column")
    use_rocksdb(stream.sparkSession)
    timed = idle_seconds is not None
    if timed:
        stream = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", delay)
    rows = stream.select(
        *keys,
        F.col(order).cast("bigint").alias("__position"),
        F.coalesce(success, F.lit(False)).alias("__ok"),
        (F.unix_millis("__ts") if timed else F.lit(0).cast("bigint")).alias("__at"),
        F.coalesce((F.lit(0.0) if value is None else value).cast("double"), F.lit(0.0)).alias("__value"),
        *(["__ts"] if timed else []),
    )
    kinds = T.StructType([rows.schema[k] for k in keys])
    out = T.StructType(
        [
            *kinds.fields,
            T.StructField("ok", T.BooleanType()),
            *[T.StructField(c, T.LongType()) for c in ("length", "position", "recent_rows")],
            T.StructField("recent_sum", T.DoubleType()),
            T.StructField("repeated", T.LongType()),
            T.StructField("silent", T.BooleanType()),
        ]
    )
    idle = None if idle_seconds is None else 1000 * idle_seconds
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("__bucket")
    return rows.select(bucket, "*").groupBy("__bucket").applyInPandasWithState(
        streak_step(kinds.fieldNames(), recent, idle), out, BUCKET_STATE, "update", "EventTimeTimeout" if timed else "NoTimeout"
    )
