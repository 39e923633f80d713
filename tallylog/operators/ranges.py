"""Running state per key when a few keys hold most rows.

Rows are range-partitioned on (keys, order) with boundaries from sampled
quantiles, so a heavy key is spread over as many partitions as its share asks
for. Each range computes its own running state; the state that a range hands on
to the next one of the same key is stitched in from a table with at most one row
per boundary.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallylog.session import parallelism

#: Sampled rows per range when boundaries are chosen (a documented bound: the
#: driver sees about SAMPLE_PER_RANGE x ranges keys). It only affects balance,
#: never results.
SAMPLE_PER_RANGE = 60

#: Rows that one range should hold at least and at most; they set how many ranges are
#: made. MOST_RANGES bounds what the driver and the plan hold of the boundaries;
#: beyond it ranges are longer.
LEAST_ROWS, ROWS_PER_RANGE, MOST_RANGES = 10_000, 4_000_000, 20_000

#: Rows looked at to find keys that hold more than a task's share. This bound only
#: affects balance, never results.
BUSY_SAMPLE = 200_000

_RANGE, _LOCAL, _CARRY, _TOP = "__range", "__local", "__carry", "__top"


def ranges_for(spark: SparkSession, rows: int) -> int:
    """How many ranges so many rows are cut into: as many as tasks run, more for many rows, fewer for few."""
    return max(1, min(rows // LEAST_ROWS, max(parallelism(spark), min(MOST_RANGES, -(-rows // ROWS_PER_RANGE)))))


def range_bounds(df: DataFrame, keys: list[str], order: str, ranges: int, sample_per_range: int = SAMPLE_PER_RANGE, rows: int | None = None) -> list[tuple]:
    """ranges - 1 boundaries (k1, .., order), ascending, from sampled quantiles.

    keys and order must not be null. `rows` is the number of rows, or somewhat more;
    they are counted if it isn't given. Fewer boundaries come back when the sample
    has fewer distinct points. String keys compare by their bytes, as in Spark.
    """
    if ranges < 2:
        return []
    points = df.select(*keys, order)
    rows = points.count() if rows is None else rows
    if not rows:
        return []
    share = min(1.0, ranges * sample_per_range / rows)
    sample = points if share == 1.0 else points.sample(share, seed=7)
    found = sorted(tuple(r) for r in sample.collect())
    if not found:
        return []
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)})


def range_of(df: DataFrame, keys: list[str], order: str, bounds: list[tuple]) -> Column:
    """The number of boundaries below a row's (keys, order): a binary search over one constant array."""
    if not bounds:
        return F.lit(0)
    kinds = dict(df.dtypes)
    names = [f"f{i}" for i in range(len(keys) + 1)]
    shape = ",".join(f"{n}:{kinds[c]}" for n, c in zip(names, [*keys, order]))
    text = json.dumps([dict(zip(names, b)) for b in bounds])
    table = F.from_json(F.lit(text), f"array<struct<{shape}>>")
    point = F.struct(*[F.col(c).alias(n) for n, c in zip(names, [*keys, order])])
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda at, step: F.when((at + step <= len(bounds)) & (F.get(table, at + step - 1) < point), at + step).otherwise(at),
    )


#: How a running value goes on from one range into the next.
_JOIN = {
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
    "sum": lambda a, b: F.coalesce(a + b, a, b),
}
_STEP = {"max": F.max, "min": F.min, "sum": F.sum}


def windowed(df: DataFrame, keys: list[str], order: str, values: dict[str, tuple[str, Column]], inclusive: bool) -> DataFrame:
    """What running gives, by plain windows: for keys of which none holds more than a task's share (see busy_keys)."""
    along = Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return df.select("*", *[_STEP[op](value).over(along).alias(name) for name, (op, value) in values.items()])


def busy_keys(df: DataFrame, key: str, rows: int, tasks: int) -> list:
    """Keys that hold over a quarter of one task's share in a sample; they can't be more than 4 x tasks."""
    share = min(1.0, BUSY_SAMPLE / max(1, rows))
    own = df.select(F.col(key).alias("k")).where(F.col("k").isNotNull())
    counts = (own if share == 1.0 else own.sample(share, seed=11)).groupBy("k").count()
    return sorted(r[0] for r in counts.where(F.col("count") > max(LEAST_ROWS / 10 * share, rows * share / (4 * tasks))).collect())


def running(
    df: DataFrame, keys: list[str], order: str, values: dict[str, tuple[str, Column]], inclusive: bool, ranges: int | None = None, rows: int | None = None,
    bounds: list[tuple] | None = None,
) -> DataFrame:
    """df with one column per entry of `values`: ('max' | 'min' | 'sum', expression) over the rows of the same keys up to each row.

    Without `inclusive` only rows with a smaller `order` count, with it those with
    an equal one too. Expressions of max and min may be of any ordered type,
    structs included (a struct that begins with the order column gives the row
    before). Null where no such row has a value.

    Rows whose keys or order are null have no place in any sequence and are left
    out. Rows with equal order share a range. A key may hold any share of the
    rows: it is cut at the sampled boundaries. Columns of df beyond those named
    are kept whatever their names, except names that start with two underscores.
    An empty df gives an empty result. `order` is of an integer type. `rows`, the
    number of rows or somewhat more where the caller knows it, saves counting them;
    `bounds` (see range_bounds), those of rows with the same keys, saves sampling too.
    """
    df = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, order]]))
    spark = df.sparkSession
    if bounds is None:
        rows = df.count() if rows is None else rows
        bounds = range_bounds(df, keys, order, ranges or ranges_for(spark, rows), rows=rows)
    cut = df.withColumn(_RANGE, range_of(df, keys, order, bounds))
    # repartitionById is exact: one range per partition, none by chance together
    spread = cut.repartitionById(len(bounds) + 1, _RANGE)
    within = Window.partitionBy(_RANGE, *keys).orderBy(order).rangeBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = spread.select("*", *[_STEP[op](value).over(within).alias(_LOCAL + name) for name, (op, value) in values.items()])
    if not bounds:
        return local.withColumnsRenamed({_LOCAL + name: name for name in values}).drop(_RANGE)
    # only keys that own a boundary can continue from one range into the next
    kinds = dict(df.dtypes)
    owners = spark.createDataFrame(sorted({b[:-1] for b in bounds}), ",".join(f"`{k}` {kinds[k]}" for k in keys))
    state = (
        df.join(F.broadcast(owners), keys, "left_semi")
        .withColumn(_RANGE, range_of(df, keys, order, bounds))
        .groupBy(*keys, _RANGE)
        .agg(*[_STEP[op](value).alias(_TOP + name) for name, (op, value) in values.items()])
    )
    earlier = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = state.select(*keys, _RANGE, F.lag(_RANGE).over(Window.partitionBy(*keys).orderBy(_RANGE)).alias("__goes_on"), *[_STEP[op](_TOP + name).over(earlier).alias(_CARRY + name) for name, (op, _) in values.items()])
    carry = carried.where(F.col("__goes_on").isNotNull()).drop("__goes_on")
    # carry has at most one row per boundary, so it is safe to broadcast
    joined = local.join(F.broadcast(carry), [*keys, _RANGE], "left")
    return joined.select(*[F.col(c) for c in df.columns], *[_JOIN[op](F.col(_LOCAL + name), F.col(_CARRY + name)).alias(name) for name, (op, _) in values.items()])


def running_before(df: DataFrame, keys: list[str], order: str, value: Column, name: str, ranges: int | None = None, rows: int | None = None) -> DataFrame:
    """df with column `name`: the largest `value` among the rows of the same keys with a smaller `order` (see running)."""
    return running(df, keys, order, {name: ("max", value)}, inclusive=False, ranges=ranges, rows=rows)


def positions(df: DataFrame, keys: list[str], order: str, name: str, ranges: int | None = None) -> DataFrame:
    """df with column `name`: each row's place, from 1, within its keys by a unique `order` (see running)."""
    return running(df, keys, order, {name: ("sum", F.lit(1).cast("long"))}, inclusive=True, ranges=ranges)


def late_rows(df: DataFrame, key: str, order: str, clock: str, slack: int, ranges: int | None = None) -> DataFrame:
    """(key, order, clock) of the rows whose clock is more than `slack` below the largest clock seen before them in their key.

    "Before" is by order. Rows with a null key, order or clock are no candidates
    and aren't compared with; equal orders don't see one another; a repeated row
    comes out as often as it went in. Columns besides the three are dropped,
    whatever their names. See running for heavy keys and empty input.
    """
    rows = df.where(F.col(clock).isNotNull()).select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(clock).alias("c"))
    # all rows are counted, not only those with a clock: of stored tables the footers tell
    seen = running_before(rows, ["k"], "o", F.col("c"), "seen", ranges, df.count())
    return seen.where(F.col("seen") - F.col("c") > slack).select(F.col("k").alias(key), F.col("o").alias(order), F.col("c").alias(clock))
