"""Order-dependent columns over keys of any size.

A plain window puts all rows of a key in one task, which fails when one key holds a large share
of a log. These operators cut every key into chunks by a function of the order column (a log
segment, an hour). Windows run inside a chunk; what a chunk needs from the chunks before it is
one small summary row per key and chunk, carried forward over those rows only, and on two levels:
within a span of chunks, and from span to span. So no task holds more than the summaries of one
span of a key, or one row per span. Whole rows are
shuffled and sorted once, by key and chunk; the summaries come from partial aggregates, or from a
second pass over the few columns they need.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Positions per chunk. A log position is a byte offset (or a dense number), so this also bounds
# the rows of a chunk, and 100 TB of log are 24 million summary rows of a key at most.
LOG_SEGMENT = 1 << 22

# Positions per span of chunks, where two levels are asked for: 65,536 chunks of the default size.
LOG_SPAN = 1 << 38

_KEY, _CHUNK, _SPAN = "__key", "__chunk", "__span"


def log_chunk(position: Column, size: int = LOG_SEGMENT) -> Column:
    return position - F.pmod(position, F.lit(size))


def time_chunk(ts: Column, unit: str = "hour") -> Column:
    return F.date_trunc(unit, ts)


def _chunked(df: DataFrame, keys: Sequence[str], chunk: Column) -> DataFrame:
    # A struct key is never null itself, so null keys group and join like any other value.
    return df.withColumns({_KEY: F.struct(*[F.col(f"`{k}`") for k in keys]), _CHUNK: chunk})


def _local(order: Sequence[str]) -> W:
    return W.partitionBy(_KEY, _CHUNK).orderBy(*order)


def _carry(summary: DataFrame, specs: Mapping[str, tuple[str, Column]], span: int | None) -> DataFrame:
    """``summary`` (one row per key and chunk) with what the earlier chunks of the key hand on.

    Kinds are ``sum``, ``max`` and ``last`` (the newest value that is not null); null before the
    first chunk.
    """
    if span is None:
        before = W.partitionBy(_KEY).orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, -1)
        over = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
        return summary.withColumns({name: over[kind](value).over(before) for name, (kind, value) in specs.items()})
    dtype = summary.schema[_CHUNK].dataType
    timed = isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))
    number = F.date_trunc("month", _CHUNK) if timed else F.floor(F.col(_CHUNK) / F.lit(span))
    rows = summary.withColumns({_SPAN: number, **{f"__x_{n}": c for n, (_, c) in specs.items()}})
    within = W.partitionBy(_KEY, _SPAN).orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy(_KEY).orderBy(_SPAN).rowsBetween(W.unboundedPreceding, -1)
    near, far, whole, both = {}, [], [], {}
    for name, (kind, _) in specs.items():
        held, total, earlier, here = F.col(f"__x_{name}"), F.col(f"__t_{name}"), F.col(f"__f_{name}"), F.col(f"__n_{name}")
        if kind == "sum":
            of_span, inside, outside = F.sum(held), F.sum(held).over(within), F.sum(total).over(across)
            joined = F.when(here.isNotNull() | earlier.isNotNull(), F.coalesce(here, F.lit(0)) + F.coalesce(earlier, F.lit(0)))
        elif kind == "max":
            of_span, inside, outside = F.max(held), F.max(held).over(within), F.max(total).over(across)
            joined = F.greatest(here, earlier)
        else:
            of_span = F.max_by(held, F.when(held.isNotNull(), F.col(_CHUNK)))
            inside, outside = F.last(held, ignorenulls=True).over(within), F.last(total, ignorenulls=True).over(across)
            joined = F.coalesce(here, earlier)
        whole.append(of_span.alias(f"__t_{name}"))
        far.append(outside.alias(f"__f_{name}"))
        near[f"__n_{name}"] = inside
        both[name] = joined
    spans = rows.groupBy(_KEY, _SPAN).agg(*whole).select(_KEY, _SPAN, *far)
    return rows.withColumns(near).join(spans, [_KEY, _SPAN]).withColumns(both).select(*summary.columns, *specs)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    specs: Mapping[str, tuple[str, Column]],
    span: int | None = None,
) -> DataFrame:
    """Running values per key, the current row included.

    ``specs`` maps a new column to ``(kind, value)``: ``sum`` and ``max``; ``last``, the newest
    value that is not null; ``prev``, the value of the row before (null on the first row).
    ``order`` must be a total order within a key and must not decrease from chunk to chunk.
    """
    rows = _chunked(df, keys, chunk)
    newest = F.struct(*[F.col(o) for o in order])
    summary, carried, inside, final = [], {}, {}, []
    local = _local(order)
    so_far = local.rowsBetween(W.unboundedPreceding, W.currentRow)
    for name, (kind, value) in specs.items():
        held, into, here = F.col(f"__s_{name}"), F.col(f"__c_{name}"), F.col(f"__l_{name}")
        boxed = F.struct(value.alias("v"))
        if kind == "sum":
            part, carry, own = F.sum(value), "sum", F.sum(value).over(so_far)
            result = F.coalesce(here, F.lit(0)) + F.coalesce(into, F.lit(0))
        elif kind == "max":
            part, carry, own = F.max(value), "max", F.max(value).over(so_far)
            result = F.greatest(here, into)
        elif kind == "last":
            known = F.when(value.isNotNull(), boxed)
            part = F.max_by(known, F.when(value.isNotNull(), newest))
            carry = "last"
            own = F.last(known, ignorenulls=True).over(so_far)
            result = F.coalesce(here, into).getField("v")
        elif kind == "prev":
            part, carry = F.max_by(boxed, newest), "last"
            own = F.lag(boxed).over(local)
            result = F.coalesce(here, into).getField("v")
        else:
            raise ValueError(f"unknown running value: {kind}")
        summary.append(part.alias(f"__s_{name}"))
        carried[f"__c_{name}"] = (carry, held)
        inside[f"__l_{name}"] = own
        final.append(result.alias(name))
    carry_rows = _carry(rows.groupBy(_KEY, _CHUNK).agg(*summary), carried, span).select(_KEY, _CHUNK, *carried)
    # Windows before the join: the join then finds its rows sorted.
    joined = rows.withColumns(inside).join(carry_rows, [_KEY, _CHUNK], "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *final)


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, name: str = "rn", span: int | None = None
) -> DataFrame:
    """Row number within a key, from 1."""
    return running(df, keys, order, chunk, {name: ("sum", F.lit(1).cast("bigint"))}, span)


def batch_numbers(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    size: int,
    name: str = "batch_id",
    span: int | None = None,
) -> DataFrame:
    """Number of the fixed-size batch a row falls in, per key, from 0."""
    rows = numbered(df, keys, order, chunk, "__rn", span)
    return rows.withColumn(name, F.floor((F.col("__rn") - 1) / F.lit(size)).cast("bigint")).drop("__rn")


def order_violations(
    df: DataFrame, keys: Sequence[str], arrival: Sequence[str], chunk: Column, position: str, span: int | None = None
) -> DataFrame:
    """Rows whose position is not above the position of the row that arrived before."""
    rows = running(df, keys, arrival, chunk, {"previous": ("prev", F.col(position))}, span)
    return rows.where(F.col(position) <= F.col("previous"))


def streaks(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, success: Column) -> DataFrame:
    """``consecutive_successes`` and ``consecutive_failures`` up to each row.

    A chunk hands on its length, and for either outcome the run it ends with and whether the run began in the
    chunk. Runs add up over chunks that one outcome fills, so what a chunk is handed is a running sum less
    its value at the last break: both from one window over the summaries.
    """
    local = _local(order)
    so_far = local.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = _chunked(df, keys, chunk).withColumns(
        {"__ok": F.coalesce(success, F.lit(False)), "__n": F.row_number().over(local).cast("bigint")}
    )
    kinds = {"__good": ("__ok", "consecutive_successes"), "__bad": ("NOT __ok", "consecutive_failures")}
    # Place of the last row of each outcome, so far and in the whole chunk.
    last = {k: F.when(F.expr(test), F.col("__n")) for k, (test, _) in kinds.items()}
    rows = rows.withColumns({k: F.max(c).over(so_far) for k, c in last.items()})
    other = {"__good": "__bad", "__bad": "__good"}

    summary = rows.groupBy(_KEY, _CHUNK).agg(F.max("__n").alias("__count"), *[F.max(k).alias(f"{k}_at") for k in kinds])
    by_chunk = W.partitionBy(_KEY).orderBy(_CHUNK)
    upto = by_chunk.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = by_chunk.rowsBetween(W.unboundedPreceding, -1)
    run = {k: F.col("__count") - F.coalesce(F.col(f"{other[k]}_at"), F.lit(0)) for k in kinds}
    summary = summary.withColumns({f"{k}_sum": F.sum(c).over(upto) for k, c in run.items()})
    broken = {k: F.when(F.col(f"{other[k]}_at").isNotNull(), F.col(f"{k}_sum") - c) for k, c in run.items()}
    handed = {k: F.coalesce(F.max(f"{k}_sum").over(before), F.lit(0)) - F.coalesce(F.max(broken[k]).over(before), F.lit(0)) for k in kinds}
    carry = summary.select(_KEY, _CHUNK, *[c.alias(f"{k}_in") for k, c in handed.items()])
    joined = rows.join(carry, [_KEY, _CHUNK], "left")

    def since(k: str) -> Column:
        """Rows since the last one of the other outcome, or since the chunk began and what came before it."""
        broke = F.col(other[k])
        return F.when(broke.isNotNull(), F.col("__n") - broke).otherwise(F.col("__n") + F.col(f"{k}_in"))

    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[since(k).alias(name) for k, (_, name) in kinds.items()])


def moving_mean(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    values: Mapping[str, Column],
    width: int = 10,
) -> DataFrame:
    """Sum over, and number of, the last ``width`` rows per key: ``<name>_sum`` and ``window_rows``.

    A chunk hands its last ``width - 1`` values on, so the first rows of the next chunk see them.
    """
    local = _local(order)
    recent = local.rowsBetween(-(width - 1), 0)
    whole = W.partitionBy(_KEY, _CHUNK)
    keep = width - 1
    rows = _chunked(df, keys, chunk)
    rows = rows.withColumns({f"__v_{n}": c for n, c in values.items()})
    rows = rows.withColumns(
        {
            "__n": F.row_number().over(local).cast("int"),
            "__count": F.count(F.lit(1)).over(whole),
            **{f"__sum_{n}": F.sum(f"__v_{n}").over(recent) for n in values},
        }
    )
    item = F.struct(*[F.col(o) for o in order], *[F.col(f"__v_{n}") for n in values])
    tail = F.when(F.col("__n") > F.col("__count") - keep, item)
    summary = rows.groupBy(_KEY, _CHUNK).agg(F.sort_array(F.collect_list(tail)).alias("__tail"))
    before = W.partitionBy(_KEY).orderBy(_CHUNK).rowsBetween(-keep, -1)
    # At most width - 1 tails of width - 1 items each.
    carry = summary.select(_KEY, _CHUNK, F.flatten(F.collect_list("__tail").over(before)).alias("__carry"))
    joined = rows.join(carry, [_KEY, _CHUNK], "left")
    inside = F.least(F.col("__n"), F.lit(width))
    borrowed = F.least(F.lit(width) - inside, F.size("__carry"))
    joined = joined.withColumn(
        "__extra",
        F.when(borrowed > 0, F.slice("__carry", F.size("__carry") - borrowed + 1, borrowed)).otherwise(
            F.slice("__carry", F.lit(1), F.lit(0))
        ),
    )

    def total(name: str) -> Column:
        zero = F.lit(0).cast("double")
        add = F.aggregate("__extra", zero, lambda acc, e: acc + e.getField(f"__v_{name}").cast("double"))
        return F.col(f"__sum_{name}").cast("double") + add

    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[total(n).alias(f"{n}_sum") for n in values],
        (inside + F.size("__extra")).cast("bigint").alias("window_rows"),
    )
