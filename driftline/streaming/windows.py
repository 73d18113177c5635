"""Rates and held conditions on a stream, windows still open, and rows that came too late.

Stateful steps in a chain, all in append mode: counts per time step close with the watermark; each
closed step goes into a list state per key that gives the trailing sums; and a value state per key
tells how long a condition has held. Nothing but closed steps meets the later two, so a hot key costs
them one row per step, and their state is bounded by the longest window.

What the watermark has not closed is not lost: it is counted in batch from the rows past the
watermark, and a heartbeat row of a later time closes everything before it.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from driftline.operators import metrics
from driftline.streaming.keyed import use_rocksdb

# Windows of the shipped rate rules, and the step they are evaluated at, in seconds.
RATE_WINDOWS, RATE_STEP = (300, 1800), 30


# --- what a run has read and dropped ----------------------------------------------------------


@dataclass
class Totals:
    """Sums over all batches of a run. ``dropped`` is what stateful steps report: late rows after partial sums."""

    batches: int = 0
    rows: int = 0
    dropped: int = 0
    watermark: str | None = None
    error: str | None = None
    done: threading.Event = field(default_factory=threading.Event)


class RunTotals(StreamingQueryListener):
    """Adds up the progress of runs as it is reported, so that no number of batches is too many to keep."""

    def __init__(self) -> None:
        self.runs: dict[str, Totals] = {}
        self.lock = threading.Lock()

    def of(self, run_id: str) -> Totals:
        with self.lock:
            return self.runs.setdefault(str(run_id), Totals())

    def onQueryStarted(self, event) -> None:
        self.of(event.runId)

    def onQueryProgress(self, event) -> None:
        progress = json.loads(event.progress.json)
        totals = self.of(progress["runId"])
        totals.batches += 1
        totals.rows += sum(max(0, s.get("numInputRows") or 0) for s in progress["sources"])
        totals.dropped += sum(s.get("numRowsDroppedByWatermark") or 0 for s in progress["stateOperators"])
        totals.watermark = progress.get("eventTime", {}).get("watermark") or totals.watermark

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        totals = self.of(event.runId)
        totals.error = event.exception
        totals.done.set()


def run_watched(spark: SparkSession, start: Callable[[], StreamingQuery], timeout: float = 60.0) -> Totals:
    """Runs a query to its end and returns its totals. The watermark is that of its last batch."""
    listener = RunTotals()
    spark.streams.addListener(listener)
    try:
        query = start()
        query.awaitTermination()
        totals = listener.of(query.runId)
        # Progress is reported behind the run; its end is reported last.
        if not totals.done.wait(timeout):
            raise RuntimeError("the end of the stream was not reported")
        return totals
    finally:
        spark.streams.removeListener(listener)


def watermark_of(totals: Totals, kind: T.DataType | None = None) -> Column:
    """The last watermark as a literal; before any it is the beginning of time."""
    at = datetime.fromisoformat((totals.watermark or "1970-01-01T00:00:00Z").replace("Z", "+00:00"))
    return F.timestamp_micros(F.lit(int(at.timestamp() * 1_000_000))).cast(kind or T.TimestampType())


# --- windows that are still open --------------------------------------------------------------


def open_windows(
    log: DataFrame, ts: str, totals: Totals, window: str, keys: Sequence[Column], slide: str | None = None
) -> DataFrame:
    """Events of the windows that end after the run's last watermark, as ``window_counts`` gives the others.

    ``log`` is what the stream has read, in batch. Only rows less than a window before the watermark are
    read; rows of open windows are never late, so stream and batch together count every row that was not dropped.
    """
    kind = log.schema[ts].dataType
    mark = watermark_of(totals, kind)
    rows = log.where(F.col(ts) >= mark - F.expr(f"INTERVAL {window}"))
    counts = rows.groupBy(F.window(F.col(ts), window, slide or window).alias("window"), *keys).agg(F.count(F.lit(1)).alias("events"))
    return counts.where(F.col("window.end") > mark)


def late_rows(totals: Totals, closed: DataFrame, opened: DataFrame, events: str = "events") -> DataFrame:
    """One row ``late_rows``: rows read less those counted in closed and in open windows (of windows that do not overlap)."""
    counted = closed.select(events).unionByName(opened.select(events)).agg(F.coalesce(F.sum(events), F.lit(0)).alias("n"))
    return counted.select((F.lit(totals.rows) - F.col("n")).cast("bigint").alias("late_rows"))


# --- trailing sums ----------------------------------------------------------------------------


class TrailingSums(StatefulProcessor):
    """List state: the closed steps of the longest window. Every new step gives the sums of the windows that end there."""

    def __init__(self, keys: Sequence[str], windows: Sequence[int], step: int):
        self.keys, self.windows, self.step = list(keys), list(windows), step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.steps = handle.getListState("steps", "at bigint, total bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("at")
        held = list(self.steps.get())
        at = np.array([h[0] for h in held] + new["at"].tolist(), np.int64)
        total = np.array([h[1] for h in held] + new["total"].tolist(), np.int64)
        sums = np.concatenate(([0], np.cumsum(total)))
        fresh = np.arange(len(held), len(at))
        out = {k: [v] * len(fresh) for k, v in zip(self.keys, key, strict=True)} | {"at": at[fresh]}
        for window in self.windows:
            first = np.searchsorted(at, at[fresh] - (window - self.step))
            out[f"total_{window}"] = sums[fresh + 1] - sums[first]
        # A later step looks back on what is less than the longest window before it.
        keep = at > at[-1] - (max(self.windows) - self.step)
        self.steps.put([(int(a), int(t)) for a, t in zip(at[keep], total[keep], strict=True)])
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def rates(
    stream: DataFrame,
    keys: Sequence[str],
    ts: str,
    delay: str,
    windows: Sequence[int] = RATE_WINDOWS,
    step: int = RATE_STEP,
    amount: Column | None = None,
) -> DataFrame:
    """Per key and closed step with rows: ``at`` (epoch second of its end) and ``total_<w>, rate_<w>`` per window of w seconds.

    The stream twin of ``metrics.moving_rate``. Append mode; a step closes when the watermark passes its end.
    """
    use_rocksdb(stream.sparkSession)
    value = F.lit(1).cast("bigint") if amount is None else amount.cast("bigint")
    steps = (
        stream.withWatermark(ts, delay)
        .groupBy(F.window(ts, f"{step} seconds").alias("window"), *keys)
        .agg(F.sum(value).alias("total"))
        .select(*keys, F.unix_timestamp("window.end").alias("at"), "total")
    )
    kinds = T.StructType([steps.schema[k] for k in keys])
    longs = [T.StructField(c, T.LongType()) for c in ("at", *[f"total_{w}" for w in windows])]
    sums = steps.groupBy(*keys).transformWithStateInPandas(
        TrailingSums(keys, windows, step), T.StructType([*kinds.fields, *longs]), "append", "None"
    )
    return sums.withColumns({f"rate_{w}": F.col(f"total_{w}") / F.lit(float(w)) for w in windows})


def open_rates(
    log: DataFrame,
    keys: Sequence[str],
    ts: str,
    totals: Totals,
    windows: Sequence[int] = RATE_WINDOWS,
    step: int = RATE_STEP,
    amount: Column | None = None,
) -> DataFrame:
    """The same columns for the steps that end after the run's last watermark, from the log's last rows in batch."""
    kind = log.schema[ts].dataType
    mark = watermark_of(totals, kind)
    rows = log.where(F.col(ts) >= mark - F.expr(f"INTERVAL {max(windows) + step} SECONDS"))
    value = F.lit(1).cast("bigint") if amount is None else amount.cast("bigint")
    steps = metrics.step_sums(rows, keys, ts, step, {f"total_{w}": value for w in windows})
    parts = [metrics.moving_sums(steps, keys, [f"total_{w}"], w, step) for w in windows]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, [*keys, "at"])
    out = out.where(F.col("at") > F.unix_micros(mark.cast("timestamp")) / F.lit(1_000_000))
    return out.withColumns({f"rate_{w}": F.col(f"total_{w}") / F.lit(float(w)) for w in windows})


# --- conditions that hold ---------------------------------------------------------------------


class Held(StatefulProcessor):
    """Value state: since when, until when and for how many points the condition has held."""

    def __init__(self, keys: Sequence[str], hold: int):
        self.keys, self.hold = list(keys), hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "since bigint, until bigint, samples bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("at")
        run = self.run.get() if self.run.exists() else None
        found: dict[int, tuple] = {}
        for at, on in zip(new["at"].tolist(), new["on"].tolist(), strict=True):
            if not on:
                run = None
                continue
            run = (run[0], at, run[2] + 1) if run else (at, at, 1)
            if run[1] - run[0] >= self.hold:
                found[run[0]] = run
        if run:
            self.run.update(run)
        else:
            self.run.clear()
        if found:
            out = {k: [v] * len(found) for k, v in zip(self.keys, key, strict=True)}
            out |= {c: [r[i] for r in found.values()] for i, c in enumerate(("since", "until", "samples"))}
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def held(points: DataFrame, keys: Sequence[str], condition: Column, hold_seconds: int) -> DataFrame:
    """Runs of points on which ``condition`` held for ``hold_seconds``, from a stream of closed points with ``at``.

    The stream twin of ``alerts.episodes``. A run is given when it has held long enough and again, longer, with
    each batch that goes on with it: the newest row per key and ``since`` counts.
    """
    use_rocksdb(points.sparkSession)
    rows = points.select(*keys, F.col("at").cast("bigint").alias("at"), F.coalesce(condition, F.lit(False)).alias("on"))
    kinds = T.StructType([rows.schema[k] for k in keys])
    longs = [T.StructField(c, T.LongType()) for c in ("since", "until", "samples")]
    return rows.groupBy(*keys).transformWithStateInPandas(
        Held(keys, hold_seconds), T.StructType([*kinds.fields, *longs]), "append", "None"
    )


def without_heartbeats(stream: DataFrame, ts: str, delay: str, heartbeat: Column) -> DataFrame:
    """Rows that are no heartbeats, behind a watermark that heartbeats move on.

    The test reads the event time as well, or it would be moved before the watermark and hide the heartbeats.
    """
    beat = F.when(F.col(ts).isNotNull(), F.coalesce(heartbeat, F.lit(False))).otherwise(F.lit(False))
    return stream.withWatermark(ts, delay).where(~beat)
