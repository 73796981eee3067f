"""Registry of queries: name -> (spark, sf_dir) -> DataFrame, and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL expresses it, its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as signal points: idx, signal_id, ts, kind, value."""
    ship(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("idx"), F.col("user_id").alias("signal_id"), "ts", F.col("event_type").alias("kind"), "value")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table: id, vector, label."""
    ship(spark)
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def r6(c: Column | str) -> Column:
    """Six decimals: sums of doubles depend on their order."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)
