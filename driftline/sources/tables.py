"""Full-table scans, unions of sources and bulk writes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def scan_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    split_column: str,
    lower: int,
    upper: int,
    partitions: int,
    fetch_size: int = 1000,
    **options: str,
) -> DataFrame:
    """Database table in ``partitions`` key ranges read side by side; filters go to the database."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=split_column, fetchsize=str(fetch_size), **options)
        .options(lowerBound=str(lower), upperBound=str(upper), numPartitions=str(partitions))
        .load()
    )


def documents(df: DataFrame, key: Sequence[str], table: str) -> DataFrame:
    """``(table_name, pk, doc)`` with the whole row as one JSON text.

    Serialise last: every earlier step should still see columns it can prune.
    """
    pk = F.concat_ws(":", *[F.col(k).cast("string") for k in key])
    doc = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    return df.select(F.lit(table).alias("table_name"), pk.alias("pk"), doc.alias("doc"))


def union_sources(sources: Mapping[str, DataFrame]) -> DataFrame:
    """All sources in one frame, with ``source_name``; a column a source lacks is null there."""
    frames = [df.withColumn("source_name", F.lit(name)) for name, df in sources.items()]
    result = frames[0]
    for df in frames[1:]:
        result = result.unionByName(df, allowMissingColumns=True)
    return result


def import_documents(df: DataFrame, path: str, max_records_per_file: int = 1_000_000) -> Mapping[str, int]:
    """Overwrite ``path`` with all rows; returns the counts seen while writing (no second pass)."""
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("imported"))
    counted.write.mode("overwrite").option("maxRecordsPerFile", max_records_per_file).parquet(path)
    return seen.get
