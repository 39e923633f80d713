"""Joins when one side is skewed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylog.session import parallelism

#: At most this many keys can each hold more than 1/HEAVY_KEYS of all rows, so a
#: table of such keys has a proven size bound and may be broadcast.
HEAVY_KEYS = 1000


def join_counted(rows: DataFrame, unique: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of rows with a table that has one row per key.

    `count` is a column of `unique`: how many of the `total` rows have that key.
    Keys with more than total / HEAVY_KEYS rows (fewer than HEAVY_KEYS of them,
    by counting) are joined by broadcast where their rows lie; all others, whose
    groups are small, by shuffle. No key is dropped and none is sent to one task.
    `count` isn't in the result. Null keys never match.
    """
    limit = max(1, total // HEAVY_KEYS)
    others = [c for c in unique.columns if c not in (*keys, count)]
    heavy = unique.where(F.col(count) > limit).select(*keys, F.struct(F.lit(True).alias("__found"), *others).alias("__heavy"))
    light = unique.where(F.col(count) <= limit).drop(count)
    marked = rows.join(F.broadcast(heavy), keys, "left")
    a = marked.where(F.col("__heavy").isNotNull()).select(*keys, *[c for c in rows.columns if c not in keys], *[F.col(f"__heavy.`{c}`").alias(c) for c in others])
    b = marked.where(F.col("__heavy").isNull()).drop("__heavy").join(light, keys)
    return a.unionByName(b)


def join_salted(rows: DataFrame, few: DataFrame, key: str, spread: str) -> DataFrame:
    """Inner join of rows with a much smaller table that may have several rows per key.

    A busy key's rows are spread, by a hash of the column `spread`, over as many salts
    as tasks run, and the smaller table goes to each. Null keys never match.
    """
    salts = parallelism(rows.sparkSession)
    a = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    b = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [key, "__salt"]).drop("__salt")
