"""References to records that do not exist (problem 5)."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallylog.operators.orphans import message_orphans, orphan_references
from tests.conftest import rows

DAY = datetime(2018, 1, 1)
REFS, PARENTS = "key string, at timestamp, row_no long", "key string, since timestamp"


def brute(refs, parents, removed):
    out = []
    for key, at, row in refs:
        if key is None:
            continue
        come = [s for k, s in parents if k == key]
        gone = [s for k, s in removed if k == key and s is not None]
        dated = [s for s in come if s is not None]
        if not come:
            kind = "missing"
        elif at is not None and gone and min(gone) < at:
            kind = "deleted"
        elif at is not None and dated and min(dated) > at:
            kind = "late"
        else:
            continue
        out.append((key, at, row, kind))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_like_brute_force(spark, seed):
    rng = random.Random(seed)
    keys = [None, "", *(f"k{i}" for i in range(150))]
    when = lambda: rng.choice([None, *(DAY + timedelta(hours=rng.randrange(120)) for _ in range(9))])
    refs = [(rng.choice([*keys, "k1", "k1", "k2"]), when(), i) for i in range(800)]
    refs += rng.choices(refs, k=20)
    parents = [(rng.choice(keys[:120]), when()) for _ in range(200)]
    removed = [(rng.choice(keys), when()) for _ in range(80)]
    make = lambda data, shape: spark.createDataFrame(data, shape).repartition(3)
    got = rows(orphan_references(make(refs, REFS), make(parents, PARENTS), make(removed, PARENTS), blocks=rng.choice([1, 3, 8])))
    assert got == brute(refs, parents, removed)


def test_equal_instants_are_neither_before_nor_after(spark):
    refs, parents, removed = [("a", DAY, 1), ("b", DAY, 2)], [("a", DAY), ("b", DAY - timedelta(days=1))], [("b", DAY)]
    got = rows(orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS), spark.createDataFrame(removed, PARENTS)))
    assert got == []


def test_empty_tables_and_clashing_names(spark):
    none = spark.createDataFrame([], PARENTS)
    assert rows(orphan_references(spark.createDataFrame([], REFS), none, none)) == []
    names = ("day", "n", "since", "removed_at", "parent", "code", "word", "ref", "refs", "block", "row")
    refs = spark.createDataFrame([("a", DAY, 1)] * 3, REFS).select("*", *[F.lit(0).alias(c) for c in names])
    got = orphan_references(refs, none.withColumn("parent", F.lit(1)), none).select("key", "row_no", "day", "row", "orphan_kind")
    assert rows(got) == [("a", 1, 0, 0, "missing")] * 3


def test_tables_of_the_broker(spark):
    wal = spark.createDataFrame([(1, 2, DAY, " ABC "), (2, 1, DAY, "gone"), (3, 2, None, "gone"), (4, 2, DAY, " ")], "rec_id long, rec_type int, logged_at timestamp, msg_id string")
    raft = spark.createDataFrame([(7, 3, DAY, "abc"), (8, 6, DAY, "late")], "cmd_row long, cmd_type int, applied_at timestamp, message_id string")
    messages = spark.createDataFrame([("Abc", DAY), ("late", DAY + timedelta(seconds=1))], "id string, received_at timestamp")
    expired = spark.createDataFrame([("abc ", DAY - timedelta(seconds=1))], "id string, removed_at timestamp")
    got = rows(message_orphans(wal, raft, messages, expired))
    assert got == [
        ("raft_commands", "2018-01-01", 7, "deleted"), ("raft_commands", "2018-01-01", 8, "late"),
        ("wal_records", "2018-01-01", 1, "deleted"), ("wal_records", None, 3, "missing"),
    ]
