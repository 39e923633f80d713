"""Change feeds (problem 2)."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallylog.operators import ranges
from tallylog.operators.changes import apply_changes, live_messages, message_steps, raft_live, raft_state, wal_live
from tests.conftest import rows

WAL = "rec_id long, node_id string, lsn long, rec_type int, msg_id string"
RAFT = "cmd_row long, log_index long, term long, cmd_type int, topic string, message_id string"


def norm(x):
    return (x.strip(" ").lower() or None) if x is not None else None


def brute_wal(data):
    logs = defaultdict(dict)
    for _, node, lsn, kind, msg in data:
        if node is not None and lsn is not None:
            logs[node][lsn] = (kind, norm(msg))
    out = []
    for node, log in logs.items():
        live = {}
        for lsn in sorted(log):
            kind, msg = log[lsn]
            if msg and kind == 1:
                live[msg] = lsn
            elif msg and kind == 2:
                live.pop(msg, None)
        out += [(node, m, p) for m, p in live.items()]
    return sorted(out, key=repr)


def brute_raft(data):
    best = {}
    for _, i, term, kind, topic, msg in data:
        if i is not None and (i not in best or (term is not None and (best[i][0] is None or best[i][0] < term))):
            best[i] = (term, kind, topic, norm(msg))
    live = {}
    for i in sorted(best):
        _, kind, topic, msg = best[i]
        if kind == 7 and topic is not None:
            live = {m: v for m, v in live.items() if v[0] != topic}
        elif msg and kind == 1 and msg not in live:
            live[msg] = (topic, i)
        elif msg and kind == 3 and msg in live:
            live[msg] = (live[msg][0], i)
        elif msg and kind == 2:
            live.pop(msg, None)
    return sorted((("raft", m, p) for m, (_, p) in live.items()), key=repr)


def spelled(rng, x):
    return rng.choice([x, x.upper(), f" {x}", f"{x}  "])


@pytest.fixture
def split(monkeypatch, seed):
    """Every second seed has keys so busy that they are cut into ranges."""
    if seed % 2:
        monkeypatch.setattr(ranges, "LEAST_ROWS", 20)


@pytest.mark.parametrize("seed", range(4))
def test_wal_like_replay(spark, seed, split):
    rng = random.Random(seed)
    data = [(0, node, i, rng.choice([1, 1, 2, 2, 3, None, 9]), rng.choice([None, "", "  ", *(spelled(rng, m) for m in ("hot", "hot", "hot", "m1", "m2", "m3"))])) for node in ("a", "b") for i in range(120)]
    data += rng.choices(data, k=60) + [(0, None, 1, 1, "m1"), (0, "a", None, 1, "m9")]
    rng.shuffle(data)
    assert rows(wal_live(spark.createDataFrame(data, WAL).repartition(3))) == brute_wal(data)


@pytest.mark.parametrize("seed", range(6))
def test_raft_like_replay(spark, seed, split):
    """Messages under several topics, purges between and blocked inserts included."""
    rng = random.Random(seed)
    topics = ["t1", "t2", None] if seed % 2 else ["t1", "t2", "t3"]
    data = []
    for i in range(250):
        kind = rng.choice([1, 1, 1, 2, 3, 3, 7, 6, None] if seed < 3 else [1, 1, 1, 3, 7])
        msg = None if kind == 7 else rng.choice([None, " ", *(spelled(rng, m) for m in ("hot", "hot", "m1", "m2", "m3"))])
        data.append((i, i, rng.choice([1, 2, None]), kind, rng.choice(topics), msg))
    data += [(900 + i, i, 7, rng.choice([1, 2, 3]), rng.choice(topics), rng.choice(["m1", "hot"])) for i in range(0, 250, 9)]  # a higher term at the same index
    data += rng.choices(data, k=80) + [(0, None, 1, 1, "t1", "lost")]
    rng.shuffle(data)
    raft = spark.createDataFrame(data, RAFT).repartition(3)
    assert rows(raft_live(raft)) == brute_raft(data)
    if seed == 4:
        # the second half goes on from the state that the first half left
        base = raft_state(raft.where("log_index < 120"))
        assert rows(raft_state(raft.where("log_index >= 120"), base).select(F.lit("raft"), "msg_id", "pos")) == brute_raft(data)


def test_replaying_again_or_in_parts_changes_nothing(spark):
    rng = random.Random(9)
    data = [(i, "a", i, rng.choice([1, 2]), rng.choice(["x", "y", "z"])) for i in range(60)]
    whole = rows(wal_live(spark.createDataFrame(data, WAL)))
    assert rows(wal_live(spark.createDataFrame(data * 3, WAL))) == whole
    log = spark.createDataFrame(data, WAL).select(F.col("node_id").alias("feed"), F.col("lsn").alias("pos"), F.col("rec_type").alias("kind"), "msg_id")
    args = ("feed", "msg_id", "pos", "kind", 1, 2)
    base = apply_changes(log.limit(0), log.where("pos < 30"), *args)
    assert rows(apply_changes(base, log.where("pos >= 30"), *args)) == whole


def test_empty_logs_and_other_columns(spark):
    wal, raft = spark.createDataFrame([], WAL), spark.createDataFrame([], RAFT)
    assert rows(live_messages(wal, raft)) == []
    more = [F.lit(1).alias(c) for c in ("feed", "pos", "kind", "key", "puts", "prev", "c", "sign", "until", "back", "start", "update")]
    wal = spark.createDataFrame([(1, "a", 1, 1, "x")], WAL).select("*", *more)
    raft = spark.createDataFrame([(1, 1, 1, 1, "t", "y"), (2, 2, 1, 3, "t", "y")], RAFT).select("*", *more)
    assert rows(live_messages(wal, raft)) == [("a", "x", 1), ("raft", "y", 2)]


def test_last_entry_equal_terms_and_long_ids(spark):
    long = "x" * 100_000
    raft = [(1, 5, 2, 1, "t", long), (2, 5, 2, 1, "t", long), (3, 5, 1, 2, "t", long)]
    assert rows(raft_live(spark.createDataFrame(raft, RAFT))) == [("raft", long, 5)]


def test_a_chain_of_lives_under_changing_topics(spark):
    """Each life's purge lets in the one insert that its topic hadn't blocked; which these are hangs on all before."""
    data, pos = [], 0
    for i in range(60):
        for kind, topic in ((1, f"t{i % 3}"), (1, f"t{(i + 1) % 3}"), (7, f"t{i % 3}"), (1, f"t{(i + 2) % 3}")):
            data.append((pos, pos, 1, kind, topic, "m" if kind == 1 else None))
            pos += 1
    assert rows(raft_live(spark.createDataFrame(data, RAFT))) == brute_raft(data)


def test_purges_end_only_what_is_live(spark):
    data = [(1, "a", "t"), (1, "b", "t"), (1, "c", "u"), (2, "a", None), (7, None, "t"), (1, "b", "t"), (3, "b", None), (7, None, "t"), (7, None, "t"), (2, "b", None)]
    steps = message_steps(spark.createDataFrame([(i, i, 1, kind, topic, msg) for i, (kind, msg, topic) in enumerate(data)], RAFT))
    assert rows(steps.where("kind = 0 and live").select("msg_id", "pos", "before")) == [("b", 4, 1), ("b", 7, 6)]
    assert rows(steps.where("kind = 2").select("msg_id", "live")) == [("a", True), ("b", False)]
