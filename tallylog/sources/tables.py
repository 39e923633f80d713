"""The provided tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The message envelope's columns as stored, with their types.
MESSAGE_COLUMNS = {
    "row_id": "bigint", "batch_id": "string", "received_at": "timestamp", "id": "string",
    "topic": "string", "payload": "string", "headers": "map<string,string>", "timestamp_ns": "bigint",
    "retry": "int", "max_retry": "int", "delivery_count": "int", "delay_ns": "bigint", "ttl_ns": "bigint",
    "deliver_at": "bigint", "expires_at": "bigint", "priority": "int", "exchange_name": "string",
    "routing_key": "string",
}


def table_path(folder: str, name: str) -> str:
    return f"{folder}/{name}.parquet"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table; a file or a folder of part files."""
    return spark.read.parquet(table_path(folder, name))
