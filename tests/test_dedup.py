"""One copy of each message (problem 3)."""

import random
from datetime import datetime, timedelta

import pytest

from tallylog.streaming.dedup import Left, superfluous_copies
from tests.conftest import rows

SHAPE = "row_id long, received_at timestamp, id string, delivery_count int, retry int, payload string, msg_id string, rank string, best string"
START = datetime(2018, 1, 1)


def brute(data):
    kept, out = {}, []
    low = lambda x: (x is not None, x or 0)
    rank = lambda r: (low(r[3]), low(r[4]), -r[0])
    key = lambda r: (r[2].strip(" ").lower() or None) if r[2] is not None else None
    for r in data:
        if key(r) and (key(r) not in kept or rank(r) > rank(kept[key(r)])):
            kept[key(r)] = r
    for r in data:
        if key(r) and kept[key(r)][0] != r[0]:
            out.append((key(r), r[0]))
    return sorted(out, key=repr)


def make(seed, n=300):
    rng = random.Random(seed)
    ids = [None, "", "  ", "HOT", "hot", " hot", *(f"{k}{i}" for i in range(40) for k in ("A", "a", " a"))]
    out = []
    for i in range(n):
        at = START + timedelta(minutes=i) - timedelta(minutes=rng.choice([0, 0, 0, 200]))
        out.append((i, rng.choice([at, at, at, None]), rng.choice(ids), rng.choice([None, 0, 1, 2]), rng.choice([None, 0, 1]), rng.choice([None, "", "x"]), "m", "r", "b"))
    return out


@pytest.mark.parametrize("files,watermark", [(1, "1 day"), (5, "1 minute"), (5, "3650 days")])
def test_like_brute_force_whatever_the_store_still_holds(spark, tmp_path, files, watermark):
    """With a short watermark ids leave the store and late rows pass it by; the result is the same."""
    data = make(files)
    step = len(data) // files
    for i in range(files):
        spark.createDataFrame(data[i * step : (i + 1) * step], SHAPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "m"))
    got = rows(superfluous_copies(spark, str(tmp_path / "m"), watermark, files_per_batch=1))
    assert got == brute(data[: files * step])


def test_empty_ties_and_long_ids(spark, tmp_path):
    spark.createDataFrame([], SHAPE).write.parquet(str(tmp_path / "none"))
    assert rows(superfluous_copies(spark, str(tmp_path / "none"))) == []
    long = "y" * 100_000
    data = [(i, START, long, 1, 1, None, None, None, None) for i in range(5)] + [(9, START, None, 9, 9, None, None, None, None)]
    spark.createDataFrame(data, SHAPE).write.parquet(str(tmp_path / "ties"))
    assert rows(superfluous_copies(spark, str(tmp_path / "ties"))) == [(long, i) for i in (1, 2, 3, 4)]


def test_a_key_with_most_rows(spark, tmp_path):
    data = [(i, START + timedelta(seconds=i), "hot" if i % 2 else f"id{i}", i % 7, 0, None, None, None, None) for i in range(6000)]
    spark.createDataFrame(data, SHAPE).write.parquet(str(tmp_path / "m"))
    assert rows(superfluous_copies(spark, str(tmp_path / "m"))) == brute(data)


def put(spark, path, data):
    spark.createDataFrame(data, SHAPE).coalesce(1).write.mode("append").parquet(str(path))


def test_any_number_of_batches(spark, tmp_path):
    data = make(7, 320)
    for i in range(16):
        put(spark, tmp_path / "m", data[i * 20 : i * 20 + 20])
    for batches in (1, 16):
        assert rows(superfluous_copies(spark, str(tmp_path / "m"), "30 minutes", batches=batches)) == brute(data)


def test_a_later_call_reads_only_what_is_new(spark, tmp_path):
    data, store = make(8), str(tmp_path / "store")
    put(spark, tmp_path / "m", data[:200])
    assert rows(superfluous_copies(spark, str(tmp_path / "m"), "30 minutes", store=store)) == brute(data[:200])
    put(spark, tmp_path / "m", data[200:])
    assert rows(superfluous_copies(spark, str(tmp_path / "m"), "30 minutes", store=store)) == brute(data)
    decided = spark.read.parquet(f"{store}/decisions").groupBy("kind", "row_id").count()
    assert decided.where("count > 1").isEmpty()  # no row was decided twice


def test_filter_of_what_left_forgets_nothing_and_finds_little_else():
    import numpy as np

    rng, left = np.random.default_rng(1), Left()
    known = rng.integers(0, 1 << 64, 60_000, dtype=np.uint64)
    for part in np.array_split(known, 7):
        left.add(part)
    assert left.has(known).all() and left.has(rng.integers(0, 1 << 64, 50_000, dtype=np.uint64)).mean() < 0.01
    assert len(left.layers) > 2 and not Left().has(known).any()
