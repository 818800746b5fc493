"""Tables of a folder of Parquet files as the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidekeep.functions import epoch_us

HOUR_US = 3_600_000_000
NODES = [("127.0.0.1:8001", "active"), ("127.0.0.1:8002", "active"), ("127.0.0.1:8003", "active"), ("127.0.0.1:8004", "warming"), ("127.0.0.1:8005", "draining")]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def oplog(spark: SparkSession, folder: str, modulus: int = 10007) -> DataFrame:
    """An operation log from events: keys are users, versions come out of order, errors are deletes, entries last six hours."""
    e = table(spark, folder, "events")
    return e.select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("key"), epoch_us("ts").alias("ts"), (F.col("event_id") * 7919 % modulus).alias("version"), (F.col("event_type") == "error").alias("tombstone"), "value", F.lit(6 * HOUR_US).alias("ttl")
    )


def order_keys(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_custkey").alias("value"))


def nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NODES, "addr string, status string")


def ring_nodes(spark: SparkSession, *statuses: str) -> DataFrame:
    """node, ord of the nodes with one of the statuses, in the order of their addresses."""
    found = [(a, k) for k, (a, s) in enumerate(NODES) if s in statuses]
    return spark.createDataFrame(found, "node string, ord int")


def requests(log: DataFrame, default_ttl_ms: int = 5_000) -> DataFrame:
    """An operation log from a log of requests (grp, op, key, value, version, ttl_ms, from_peer, seq).

    A set without TTL lasts default_ttl_ms; a row keeps its own group; requests from peers aren't forwarded.
    """
    ttl = F.when((F.col("op") == "set") & (F.coalesce("ttl_ms", F.lit(0)) <= 0), default_ttl_ms).otherwise(F.coalesce("ttl_ms", F.lit(0)))
    return log.where(F.col("op").isin("set", "delete")).select("seq", "grp", "op", "key", "value", "version", ttl.cast("long").alias("ttl_ms"), (~F.col("from_peer")).alias("forward"), (F.col("op") == "delete").alias("tombstone"))
