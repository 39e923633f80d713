"""Counters that are held between two limits, over split keys.

A step moves the counter, but not beyond the limits: x becomes
min(high, max(low, x + step)). Such steps in a row are again of the form
min(h, max(l, x + s)), so a range of a key's commands sums up to three numbers, and
the value with which a range begins is stitched in from those before it (see
ranges). Within a range the walk goes row by row, since what a limit cuts off
depends on all steps before; it runs over Arrow batches of sorted rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallylog.operators.ranges import range_bounds, range_of, ranges_for
from tallylog.session import ship

_NAMES = ["__range", "__key", "__order", "__step", "__start"]


def _walk(batches: Iterator[pa.RecordBatch], low: int, high: int) -> Iterator[pa.RecordBatch]:
    at, x = None, 0
    for batch in batches:
        ranges, keys, orders, steps, starts = (batch.column(i) for i in range(5))
        values, hit = [], []
        for key, step, start in zip(keys.to_pylist(), steps.to_pylist(), starts.to_pylist()):
            if key != at:
                at, x = key, start
            wanted = x + step
            x = min(high, max(low, wanted))
            values.append(x)
            hit.append(x != wanted)
        yield pa.RecordBatch.from_arrays([keys, orders, pa.array(values, pa.int64()), pa.array(hit, pa.bool_())], names=["key", "order", "value", "cut"])


def bounded(commands: DataFrame, key: str, order: str, step: Column, low: int, high: int, ranges: int | None = None) -> DataFrame:
    """(key, order, value, cut): the counter of each key after each command, from `low` on; cut: a limit held the step back.

    order is unique within a key. Commands without key or order are left out; a null
    step is 0. A key may hold any share of the commands. No commands give no rows.
    """
    ship(commands.sparkSession)
    rows = commands.where(F.col(key).isNotNull() & F.col(order).isNotNull()).select(F.col(key).alias("__key"), F.col(order).alias("__order"), F.coalesce(step.cast("long"), F.lit(0)).alias("__step"))
    n = rows.count()
    bounds = range_bounds(rows, ["__key"], "__order", ranges or ranges_for(commands.sparkSession, n), rows=n)
    cut = rows.withColumn("__range", range_of(rows, ["__key"], "__order", bounds))
    # a key's steps within a range as one step; only those before the key's last range are needed
    one = F.struct(F.lit(low).cast("long").alias("l"), F.lit(high).cast("long").alias("h"), F.lit(0).cast("long").alias("s"))

    def then(f, x):
        hold = lambda v: F.least(F.lit(high), F.greatest(F.lit(low), v))
        return F.struct(hold(f["l"] + x["step"]).alias("l"), hold(f["h"] + x["step"]).alias("h"), (f["s"] + x["step"]).alias("s"))

    kinds = dict(rows.dtypes)
    owners = commands.sparkSession.createDataFrame(sorted({b[:-1] for b in bounds}), f"`__key` {kinds['__key']}")
    parts = (
        cut.join(F.broadcast(owners), "__key", "left_semi")
        .groupBy("__key", "__range")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("__order").alias("o"), F.col("__step").alias("step")))).alias("steps"))
        .select("__key", "__range", F.aggregate("steps", one, then).alias("f"))
    )
    # at most one row per boundary
    before = Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    enter = F.aggregate("fs", F.lit(low).cast("long"), lambda x, f: F.least(f["h"], F.greatest(f["l"], x + f["s"])))
    carry = parts.withColumn("fs", F.collect_list("f").over(before)).select("__key", "__range", enter.alias("__start"))
    placed = cut.join(F.broadcast(carry), ["__key", "__range"], "left").withColumn("__start", F.coalesce("__start", F.lit(low).cast("long")))
    along = placed.repartitionById(len(bounds) + 1, "__range").sortWithinPartitions("__range", "__key", "__order").select(*_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallylog.operators.walks import _walk

        yield from _walk(batches, low, high)

    walked = along.mapInArrow(run, f"key {kinds['__key']}, order {kinds['__order']}, value bigint, cut boolean")
    return walked.select(F.col("key").alias(key), F.col("order").alias(order), "value", "cut")
