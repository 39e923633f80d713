"""References to records that are missing, were deleted before, or came later.

Keys are dictionary-encoded as integers. Sets of keys are bitmaps, one word of 64
keys per key range and period, kept only where not empty (that is the
compression: a range without members in a period takes no space). A reference
bitmap AND NOT its parent bitmap leaves the orphans of a period; the surviving
bits are decoded through the dictionary, and the exact instants are compared for
those rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallylog.functions.ids import canonical_id
from tallylog.operators.joins import join_counted
from tallylog.session import parallelism

#: Day number of keys and references without an instant: before all others.
_NO_DAY = -2147483648


_DAY = 86_400_000_000


def utc_day(at: Column) -> Column:
    """Days since 1970-01-01 in UTC, whatever the session's time zone."""
    us = F.unix_micros(at)
    return F.call_function("div", us - F.pmod(us, F.lit(_DAY)), F.lit(_DAY)).cast("int")


def _day(col: Column) -> Column:
    return F.coalesce(utc_day(col), F.lit(_NO_DAY))


def orphan_references(refs: DataFrame, parents: DataFrame, removed: DataFrame, blocks: int | None = None) -> DataFrame:
    """Rows of refs whose key isn't in parents, or not yet, or no longer, with column `orphan_kind`.

    refs: key, at (timestamp) and other columns; parents: key, since; removed: key,
    since. orphan_kind is the first that holds: 'missing', no parent row has the
    key; 'deleted', the key's earliest removal is before `at`; 'late', the earliest
    parent is after `at`. A null `at` is neither before nor after anything; a
    parent without an instant exists from ever; a removal without one doesn't count.
    References without a key aren't orphans. Repeated rows each count. Keys may be
    of any frequency: they are combined before each shuffle, and the busiest
    orphans are joined where they lie. Empty parents: every reference is missing.
    Other columns may have any names. blocks: key ranges of the dictionary.
    """
    blocks = blocks or parallelism(refs.sparkSession)
    others = [c for c in refs.columns if c not in ("key", "at")]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("struct<none:int>")
    refs = refs.where(F.col("key").isNotNull()).select("key", "at", row.alias("row"))
    day = _day(F.col("at"))
    facts = (
        refs.groupBy("key", day.alias("day")).agg(F.count("*").alias("n"))
        .select("key", F.struct("day", "n").alias("ref"), F.lit(None).cast("timestamp").alias("since"), F.lit(None).cast("timestamp").alias("gone"), F.lit(False).alias("parent"))
        .unionByName(
            parents.select("key", F.lit(None).cast("struct<day:int,n:bigint>").alias("ref"), "since", F.lit(None).cast("timestamp").alias("gone"), F.lit(True).alias("parent"))
        )
        .unionByName(
            removed.select("key", F.lit(None).cast("struct<day:int,n:bigint>").alias("ref"), F.lit(None).cast("timestamp").alias("since"), F.col("since").alias("gone"), F.lit(False).alias("parent"))
        )
        .where(F.col("key").isNotNull())
    )
    # one row per key; the array holds one entry per period the key is referenced in
    keys = (
        facts.groupBy("key")
        .agg(F.collect_list("ref").alias("refs"), F.min("since").alias("since"), F.min("gone").alias("gone"), F.max("parent").alias("parent"))
        .where(F.size("refs") > 0)
        .withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    )
    # keys first referenced at about the same time are neighbours, which keeps the words dense
    order = Window.partitionBy("block").orderBy(F.array_min("refs")["day"], "key")
    dictionary = keys.withColumn("code", F.shiftleft(F.col("block").cast("long"), 38) + F.row_number().over(order) - 1)
    word = F.shiftright("code", 6).alias("word")
    bit = F.expr("shiftleft(1L, cast(code & 63 as int))")
    marks = dictionary.select(
        word,
        bit.alias("bit"),
        F.inline(
            F.concat(
                F.transform("refs", lambda r: F.struct(r["day"].alias("day"), F.lit(0).alias("set"))),
                F.when(F.col("parent"), F.array(F.struct(_day(F.col("since")).alias("day"), F.lit(1).alias("set")))).otherwise(F.array()),
                F.when(F.col("gone").isNotNull(), F.array(F.struct(_day(F.col("gone")).alias("day"), F.lit(2).alias("set")))).otherwise(F.array()),
            )
        ),
    )
    bits = lambda which: F.coalesce(F.bit_or(F.when(F.col("set") == which, F.col("bit"))), F.lit(0))
    bitmaps = marks.groupBy("word", "day").agg(bits(0).alias("ref"), bits(1).alias("come"), bits(2).alias("gone"))
    by_word = Window.partitionBy("word")
    in_time = by_word.orderBy("day")
    known = F.bit_or("come").over(by_word)
    earlier = F.coalesce(F.bit_or("come").over(in_time.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.bit_or("gone").over(in_time.rowsBetween(Window.unboundedPreceding, 0))
    # missing: not among the parents at all; else to be compared exactly when it came in the same
    # period or later, or was removed in the same period or earlier
    bnot = lambda c: F.bitwise_not(c)
    survivors = (
        bitmaps.select("word", "day", "ref", known.alias("known"), earlier.alias("earlier"), left.alias("left"))
        .withColumn("alive", F.col("ref").bitwiseAND(bnot(F.col("known")).bitwiseOR(bnot(F.col("earlier"))).bitwiseOR(F.col("left"))))
        .where(F.col("alive") != 0)
        .select("word", "day", "alive", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("at_bit"))
        .where(F.expr("shiftright(alive, at_bit) & 1") == 1)
        .select(F.shiftleft("word", 6).bitwiseOR(F.col("at_bit").cast("long")).alias("code"), "day")
    )
    entries = dictionary.select("code", "key", "since", "gone", "parent", F.inline("refs"))
    # by shuffle: the planner takes the survivors for as few as the words they were exploded from
    decoded = entries.join(survivors.hint("merge"), ["code", "day"]).select("key", "day", "since", F.col("gone").alias("removed_at"), "parent", "n")
    total = refs.count()
    found = join_counted(refs.withColumn("day", day), decoded, ["key", "day"], "n", total)
    kind = (
        F.when(~F.col("parent"), "missing")
        .when(F.col("removed_at") < F.col("at"), "deleted")
        .when(F.col("since") > F.col("at"), "late")
    )
    return (
        found.withColumn("orphan_kind", kind)
        .where(F.col("orphan_kind").isNotNull())
        .select("key", "at", *[F.col(f"row.`{c}`").alias(c) for c in others], "orphan_kind")
    )


def log_references(wal: DataFrame, raft: DataFrame) -> DataFrame:
    """The records that refer to a message: key, at, src_table, row_no.

    Acknowledgements of the write-ahead log; acknowledgements, updates and
    requeues of the replicated log.
    """
    a = wal.where(F.col("rec_type") == 2).select(
        canonical_id("msg_id").alias("key"), F.col("logged_at").alias("at"), F.lit("wal_records").alias("src_table"), F.col("rec_id").alias("row_no")
    )
    b = raft.where(F.col("cmd_type").isin(2, 3, 6)).select(
        canonical_id("message_id").alias("key"), F.col("applied_at").alias("at"), F.lit("raft_commands").alias("src_table"), F.col("cmd_row").alias("row_no")
    )
    return a.unionByName(b)


def message_orphans(wal: DataFrame, raft: DataFrame, messages: DataFrame, expired: DataFrame) -> DataFrame:
    """(src_table, ref_day, row_no, orphan_kind) of every record whose message is missing, removed before or came later."""
    found = orphan_references(
        log_references(wal, raft),
        messages.select(canonical_id("id").alias("key"), F.col("received_at").alias("since")),
        expired.select(canonical_id("id").alias("key"), F.col("removed_at").alias("since")),
    )
    return found.select("src_table", F.date_from_unix_date(utc_day(F.col("at"))).cast("string").alias("ref_day"), "row_no", "orphan_kind")
