"""Registry, table access and the derived logs that the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.positions import lsn_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# Positions per chunk in the queries over ordered rows: small, so that the test tables fill many.
SEGMENT = 64


class Tables:
    """``t.orders`` reads ``<dir>/orders.parquet``."""

    def __init__(self, spark: SparkSession, path: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.path = spark, path.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @property
    def log(self) -> DataFrame:
        """``events`` as a change log: signup creates, error deletes, the others update."""
        return self.events.select(
            "event_id",
            F.col("user_id").alias("k"),
            op_of_event(),
            "event_type",
            "value",
            "props",
            "ts",
        )

    @property
    def change_rows(self) -> DataFrame:
        """The same log with reserved columns, as the task steps take it."""
        return self.events.select(
            op_of_event().alias("__op"),
            F.lit("Items").alias("__table"),
            F.lit("public").alias("__schema"),
            F.col("event_id").alias("__lsn"),
            "event_id",
            "user_id",
            "event_type",
            "value",
            "props",
        )

    @property
    def deliveries(self) -> DataFrame:
        """The log with every fifth change delivered twice."""
        log = self.log.withColumn("lsn", lsn_text(F.col("event_id")))
        again = log.where(F.col("event_id") % 5 == 0).withColumn("arrival", F.lit(1))
        return log.withColumn("arrival", F.lit(0)).unionByName(again)

    @property
    def snapshot(self) -> DataFrame:
        """``customer`` as the base the log is applied to."""
        return self.customer.select(
            F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("value"), F.col("c_mktsegment").alias("props")
        )

    @property
    def gaps(self) -> DataFrame:
        """``events`` with nulls: no kind on views, no amount above 50."""
        return self.events.select(
            "event_id",
            F.expr("nullif(event_type, 'view')").alias("kind"),
            F.when(F.col("value") <= 50, F.col("value")).alias("amount"),
            F.col("user_id").alias("owner"),
            "props",
        )


def op_of_event():
    return (
        F.when(F.col("event_type") == "signup", "create")
        .when(F.col("event_type") == "error", "delete")
        .otherwise("update")
        .alias("op")
    )


# The same derived tables for the SQL side.
LOG = """chg AS (SELECT event_id, user_id AS k,
    CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'update' END AS op,
    event_type, value, props, ts FROM events)"""
DELIVERIES = f"""{LOG}, dlv AS (SELECT *, 0 AS arrival FROM chg
    UNION ALL SELECT *, 1 AS arrival FROM chg WHERE event_id % 5 = 0)"""
SNAPSHOT = "snap AS (SELECT c_custkey AS k, c_acctbal AS value, c_mktsegment AS props FROM customer)"
GAPS = """gaps AS (SELECT event_id, nullif(event_type, 'view') AS kind,
    CASE WHEN value <= 50 THEN value END AS amount, user_id AS owner, props FROM events)"""


def query(name: str, sql: str | None = None):
    """Register a query; without ``sql`` only its rows can be checked."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, path: build(Tables(spark, path))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register
