"""Which index and which tasks a change belongs to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.config import Condition, SyncTask
from driftline.functions.identifiers import canonical, split_schema, split_table, table_key
from driftline.operators.conditions import predicate

# Characters of a routing table up to which it is part of the expression, as one map. A larger one
# is a table that the planner joins by its measured size.
LITERAL_CHARS = 200_000


def index_map(tasks: Sequence[SyncTask]) -> dict[str, str]:
    """Canonical table key to index, qualified and bare; a later task wins."""
    result: dict[str, str] = {}
    for task in tasks:
        if not task.index or not task.table:
            continue
        key = canonical(task.table)
        result[key] = task.index
        result[key.rsplit(".", 1)[-1] if "." in key else key] = task.index
    return result


def route_to_index(
    df: DataFrame,
    tasks: Sequence[SyncTask],
    table: str = "table_name",
    schema: str = "schema_name",
    fallback: str | None = None,
) -> DataFrame:
    """Adds ``index``: by ``schema.table``, by ``table``, then by both forms of the fallback name.

    Without any match the fallback name itself (the table name by default) is the index.
    """
    other = F.col(fallback or table)
    probes = [
        table_key(F.col(table), F.col(schema)),
        table_key(F.col(table)),
        table_key(split_table(other), split_schema(other)),
        table_key(split_table(other)),
    ]
    entries = list(index_map(tasks).items())
    if sum(len(k) + len(v) for k, v in entries) <= LITERAL_CHARS:
        found = [other]
        if entries:
            lookup = F.create_map(*[F.lit(x) for entry in entries for x in entry])
            found = [*[F.try_element_at(lookup, p) for p in probes], other]
        return df.withColumn("index", F.coalesce(*found))
    hits = []
    for i, probe in enumerate(probes):
        lookup = df.sparkSession.createDataFrame(entries, f"__key{i} string, __index{i} string")
        df = df.join(lookup, probe == F.col(f"__key{i}"), "left").drop(f"__key{i}")
        hits.append(f"__index{i}")
    return df.withColumn("index", F.coalesce(*hits, other)).drop(*hits)


def fan_out(
    df: DataFrame, tasks: Sequence[SyncTask], table: str = "table_name", schema: str = "schema_name"
) -> DataFrame:
    """One row per task of a change: tasks registered as ``schema.table`` and as ``table``.

    Rows of tables without a task are dropped. The log is read once.
    """
    lookup = df.sparkSession.createDataFrame([(t.table, t.id) for t in tasks], "__table string, task_id string")
    bare = F.substring_index(F.col(table), ".", -1)
    blank = F.coalesce(F.col(schema) == "", F.lit(True))
    names = F.when(blank, F.array(F.col(table))).otherwise(F.array(F.concat_ws(".", schema, table), bare))
    probes = df.withColumn("__probe", F.explode(F.array_distinct(names)))
    return probes.join(lookup, F.col("__probe") == F.col("__table")).drop("__probe", "__table")


def route_by_condition(df: DataFrame, rules: Sequence[tuple[Condition, str]], default: str) -> Column:
    """Index of the first rule that matches a row."""
    result = F.when(F.lit(False), F.lit(default))
    for condition, index in rules:
        result = result.when(predicate(condition, df.schema), F.lit(index))
    return result.otherwise(F.lit(default))


def mask_fields(df: DataFrame, fields: Sequence[str], suffix: str = "_hash") -> DataFrame:
    """Replace text fields by their SHA-256 digest."""
    made = {f"{f}{suffix}": F.sha2(F.col(f).cast("string"), 256) for f in fields if f in df.columns}
    return df.withColumns(made).drop(*fields) if made else df
