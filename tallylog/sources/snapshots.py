"""Snapshots of a broker's state: one table, a folder per bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_snapshot(state: DataFrame, path: str) -> None:
    """Replace the snapshot at path; readers of one bucket read only its folder."""
    state.write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
