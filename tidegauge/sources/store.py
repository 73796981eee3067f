"""Sinks and keyed storage on Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_column(df: DataFrame, path: str, compression: str = "snappy", dictionary: bool = True, mode: str = "overwrite") -> None:
    """A column as Parquet: plain or dictionary pages, none, gzip, snappy or zstd."""
    df.write.mode(mode).option("compression", compression).option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)


def read_column(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


class SegmentStore:
    """Segments by (ts, signal_id) in Parquet, partitioned by ranges of signals."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self, signal):
        return F.pmod(F.xxhash64(signal), F.lit(self.buckets)).cast("int")

    def put(self, segments: DataFrame) -> None:
        segments.withColumn("bucket", self._bucket("signal_id")).write.mode("append").partitionBy("bucket").parquet(self.path)

    def scan(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("bucket")

    def get(self, ts, signal_id: int) -> DataFrame:
        """Segments of a key: one bucket is read, and its row groups are pruned."""
        rows = self.spark.read.parquet(self.path)
        bucket = self.spark.range(1).select(self._bucket(F.lit(signal_id).cast("long"))).first()[0]
        return rows.filter((F.col("bucket") == bucket) & (F.col("signal_id") == signal_id) & (F.col("ts") == F.lit(ts))).drop("bucket")
