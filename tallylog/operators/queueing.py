"""Order, rank and capacity of queues, as queries over the message log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallylog.functions.scalars import queue_order
from tallylog.operators.ranges import positions


def fifo(messages: DataFrame, queue: str = "topic", name: str = "pos") -> DataFrame:
    """messages with their place in their queue by arrival; a queue may hold any share of the messages."""
    return positions(messages, [queue], "seq", name)


def drain(messages: DataFrame, queue: str = "topic", name: str = "pos") -> DataFrame:
    """messages with their place in delivery order: highest level first, by arrival within a level."""
    ordered = messages.withColumn("rank_key", queue_order(F.col("lvl"), F.col("seq")))
    return positions(ordered, [queue], "rank_key", name).drop("rank_key")


def head(messages: DataFrame, n: int, queue: str = "topic", name: str = "pos") -> DataFrame:
    """The first n messages of each queue in delivery order; only n per queue and partition are shuffled."""
    w = Window.partitionBy(queue).orderBy(F.desc("lvl"), "seq")
    return messages.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n).withColumn(name, F.col(name).cast("long"))


def next_message(messages: DataFrame, as_of: int, queue: str = "topic") -> DataFrame:
    """(queue, seq): what each queue delivers next; expired messages are passed over."""
    live = messages.where(~((F.col("expires_at") > 0) & (F.lit(as_of) > F.col("expires_at"))))
    return live.groupBy(queue).agg(F.min_by("seq", queue_order(F.col("lvl"), F.col("seq"))).alias("seq"))


def spilled(messages: DataFrame, capacity: int, queue: str = "topic") -> DataFrame:
    """messages with `spilled`: whether their level of the queue was full (capacity per level) when they came."""
    return positions(messages, [queue, "lvl"], "seq", "__at").withColumn("spilled", F.col("__at") > capacity).drop("__at")
