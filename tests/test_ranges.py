"""Running state over range-split keys, and late rows (problem 1)."""

import random

import pytest
from pyspark.sql import functions as F

from tallylog.operators.ranges import late_rows, positions, range_bounds, range_of, running
from tests.conftest import rows

SHAPE = "topic string, row_id long, ts long"


def brute_late(data, slack):
    out, seen = [], {}
    for topic, row, ts in data:
        if None in (topic, row, ts):
            continue
        before = [t for k, r, t in data if k == topic and r is not None and t is not None and r < row]
        if before and max(before) - ts > slack:
            out.append((topic, row, ts))
    return sorted(out, key=repr)


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_late_rows_like_brute_force(spark, ranges):
    rng = random.Random(ranges)
    data = [(rng.choice(["hot"] * 6 + ["", "b", "ü", "\U0001f469", None]), i if i % 50 else None, rng.randrange(1000) + i if rng.random() < 0.95 else None) for i in range(400)]
    df = spark.createDataFrame(data, SHAPE).repartition(5)
    assert rows(late_rows(df, "topic", "row_id", "ts", 100, ranges)) == brute_late(data, 100)


def test_one_key_is_split_over_ranges(spark):
    df = spark.range(3000).select(F.lit("hot").alias("topic"), F.col("id").alias("row_id"), (-F.col("id")).alias("ts"))
    bounds = range_bounds(df, ["topic"], "row_id", 8)
    sizes = [r["count"] for r in df.groupBy(range_of(df, ["topic"], "row_id", bounds)).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3000 / 8 * 2
    assert late_rows(df, "topic", "row_id", "ts", 10, 8).count() == 3000 - 11


def test_ties_repeats_and_boundaries(spark):
    # equal orders don't see one another; a distance equal to the slack isn't late; repeated rows come out repeatedly
    data = [("a", 1, 100), ("a", 2, 0), ("a", 2, 0), ("a", 2, 90), ("a", 3, 1), ("a", 4, 89)]
    got = rows(late_rows(spark.createDataFrame(data, SHAPE), "topic", "row_id", "ts", 10, 3))
    assert got == [("a", 2, 0), ("a", 2, 0), ("a", 3, 1), ("a", 4, 89)]


def test_empty_and_clashing_names(spark):
    assert late_rows(spark.createDataFrame([], SHAPE), "topic", "row_id", "ts", 10).count() == 0
    assert late_rows(spark.createDataFrame([(None, 1, 1), ("a", None, 1), ("a", 1, None)], SHAPE), "topic", "row_id", "ts", 10).count() == 0
    df = spark.createDataFrame([("a", 1, 100), ("a", 2, 0)], SHAPE).select("*", *[F.lit(0).alias(c) for c in ("k", "o", "c", "seen", "__range", "__carry", "__localseen")])
    assert rows(late_rows(df, "topic", "row_id", "ts", 10, 4)) == [("a", 2, 0)]


def test_running_sums_and_positions(spark):
    rng = random.Random(3)
    data = [(rng.choice("aab"), i, rng.randrange(-5, 6)) for i in range(300)]
    df = spark.createDataFrame(data, "key string, seq long, v long").repartition(4)
    got = rows(running(df, ["key"], "seq", {"s": ("sum", F.col("v")), "low": ("min", F.col("v"))}, True, 9).select("seq", "s", "low"))
    want = []
    for k, i, _ in data:
        before = [v for kk, j, v in data if kk == k and j <= i]
        want.append((i, sum(before), min(before)))
    assert got == sorted(want, key=repr)
    got = rows(positions(df, ["key"], "seq", "n", 9).select("seq", "n"))
    assert got == sorted(((i, sum(kk == k and j <= i for kk, j, _ in data)) for k, i, _ in data), key=repr)
