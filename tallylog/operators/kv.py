"""A key-value store with expiry, as folds over its command log.

Commands: set (with a time to live), get, del, expire, incr. The last command of
a key decides; where the state between commands matters, running state per key
does, which splits busy keys (see ranges).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.operators.ranges import running
from tallylog.session import materialized

SET, GET, DEL, EXPIRE, INCR = "signup", "view", "purchase", "error", "click"


def last_writes(ops: DataFrame) -> DataFrame:
    """(key, op, seq, k, ts_ns, ttl_ns) of each key's last set or del."""
    writes = ops.where(F.col("op").isin(SET, DEL))
    return writes.groupBy("key").agg(F.max_by(F.struct("op", "seq", "k", "ts_ns", "ttl_ns"), "seq").alias("w")).select("key", "w.*")


def entries(ops: DataFrame, expire_ns: int) -> DataFrame:
    """(key, value, created_ns, expires_ns): keys that are set, with the expiry of the later of set and expire (0: never)."""
    fold = ops.where(F.col("op").isin(SET, DEL, EXPIRE)).groupBy("key").agg(
        F.max_by(F.struct("op", "seq", "k", "ts_ns", "ttl_ns"), F.when(F.col("op") != EXPIRE, F.col("seq"))).alias("w"),
        F.max(F.when(F.col("op") == EXPIRE, F.struct("seq", "ts_ns"))).alias("e"),
    )
    by_set = F.when(F.col("w.ttl_ns") > 0, F.col("w.ts_ns") + F.col("w.ttl_ns")).otherwise(F.lit(0))
    expires = F.when(F.col("e.seq") > F.col("w.seq"), F.col("e.ts_ns") + expire_ns).otherwise(by_set)
    return fold.where(F.col("w.op") == SET).select("key", F.col("w.k").alias("value"), F.col("w.ts_ns").alias("created_ns"), expires.alias("expires_ns"))


def alive(as_of: int) -> Column:
    """Without an expiry, or not past it."""
    return (F.col("expires_ns") == 0) | (F.lit(as_of) <= F.col("expires_ns"))


def gets(ops: DataFrame) -> DataFrame:
    """(seq, key, value): what each get finds: the value of the last set before it, null after a del or before any set.

    Less than the store's get, as in the SQL twins: a key past its expiry is still
    found, and values that increments wrote aren't seen.
    """
    last = F.struct("seq", F.when(F.col("op") == SET, F.col("k")).alias("k"))
    seen = running(ops.where(F.col("op").isin(SET, DEL, GET)), ["key"], "seq", {"before": ("max", F.when(F.col("op") != GET, last))}, inclusive=False)
    return seen.where(F.col("op") == GET).select("seq", "key", F.col("before.k").alias("value"))


def increments(ops: DataFrame) -> DataFrame:
    """(seq, key, value): the counter after each incr; a set gives a new start, a del starts from 0.

    Less than the store's incr, as in the SQL twin: a key past its expiry goes on
    from its old value, and a delta of 0 adds 0 where the handler adds 1.
    """
    steps = ops.where(F.col("op").isin(SET, DEL, INCR)).select("seq", "key", "op", "k")
    added = F.when(F.col("op") == INCR, F.col("k")).otherwise(F.lit(0)).cast("long")
    summed = materialized(running(steps, ["key"], "seq", {"total": ("sum", added)}, inclusive=True), "increments")
    start = F.when(F.col("op") == SET, F.col("k")).otherwise(F.lit(0)) - F.col("total")
    based = running(summed, ["key"], "seq", {"base": ("max", F.when(F.col("op") != INCR, F.struct("seq", start.alias("start"))))}, inclusive=False)
    return based.where(F.col("op") == INCR).select("seq", "key", (F.col("total") + F.coalesce(F.col("base.start"), F.lit(0))).cast("long").alias("value"))


def evicted(live: DataFrame, most: int) -> DataFrame:
    """Entries beyond the `most` newest: the oldest go first. Only the entry where the cut lies is taken to the driver."""
    last = live.select("created_ns", "key").orderBy(F.desc("created_ns"), "key").offset(max(0, most - 1)).limit(1).collect()
    if not last:
        return live.limit(0)
    at, key = last[0]
    return live.where((F.col("created_ns") < at) | ((F.col("created_ns") == at) & (F.col("key") > key)) | F.lit(most <= 0))
