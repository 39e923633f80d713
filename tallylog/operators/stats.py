"""Counts, rates, lag and alerts over logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_format(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """(kind, name, n) of several counts (name, n)."""
    tagged = [df.select(F.lit(kind).alias("kind"), F.col("name").cast("string").alias("name"), F.col("n").cast("long").alias("n")) for kind, df in parts]
    return reduce(DataFrame.unionByName, tagged)


def counters(log: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """(name, value): how many rows meet each condition, from one pass."""
    return named(log.agg(*[F.count_if(c).alias(n) for n, c in tests.items()]))


def named(row: DataFrame) -> DataFrame:
    """(name, value): the columns of a single row."""
    return row.select(F.stack(F.lit(len(row.columns)), *[x for n in row.columns for x in (F.lit(n), F.col(n).cast("long"))]).alias("name", "value"))


def held(series: DataFrame, at: str, over: Column, seconds: int, least: int) -> DataFrame:
    """(start, end, n): runs of at least `least` windows, each `seconds` after the one before, for which `over` holds; a window without rows ends a run."""
    place = F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / seconds)
    hits = series.where(over).withColumn("__island", place - F.row_number().over(Window.orderBy(at)))  # one row per window
    return hits.groupBy("__island").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n")).where(F.col("n") >= least).drop("__island")


def hourly(log: DataFrame, at: str, counts: dict[str, Column]) -> DataFrame:
    """One row per hour that has rows, with a count per condition."""
    return log.groupBy(F.date_trunc("hour", at).cast("timestamp_ntz").alias("hour")).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


def streaks(series: DataFrame, order: str, over: Column, least: int) -> DataFrame:
    """(start, end, n): runs of at least `least` consecutive rows of a short series for which `over` holds.

    The series is one row per period, aggregated before; its window isn't partitioned.
    """
    by = Window.orderBy(order)
    flagged = series.withColumn("__over", over).withColumn("__at", F.row_number().over(by))
    hits = flagged.where("__over").withColumn("__island", F.col("__at") - F.row_number().over(by))
    return hits.groupBy("__island").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n")).where(F.col("n") >= least).drop("__island")
