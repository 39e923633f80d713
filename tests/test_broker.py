"""Routing, queues, the binary log, snapshots and the stateful stream."""

import io
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallylog.functions import scalars as S
from tallylog.operators import kv, queueing, routing, stats, walks
from tallylog.session import ship
from tallylog.sources import frames, generator, snapshots, wal
from tallylog.streaming import jobs
from tallylog.streaming.dedup import run_to_end
from tests.conftest import rows

# (routing key, pattern, matches)
TOPICS = [
    ("order.created", "order.created", True), ("order.created", "order.updated", False), ("order.created", "order.*", True),
    ("order.created.vn", "order.*", False), ("order.created", "*.created", True), ("user.created", "*.created", True),
    ("order.created", "order.#", True), ("order.created.vn", "order.#", True), ("order", "order.#", True), ("user.created", "order.#", False),
    ("a.b.c.created", "#.created", True), ("created", "#.created", True), ("order.created.vn", "order.*.vn", True), ("order.updated.vn", "order.*.vn", True),
    ("order.created.us", "order.*.vn", False), ("a.b.c.d", "a.#.d", True), ("a.d", "a.#.d", True), ("anything.at.all", "#", True), ("single", "#", True),
    ("", "*", True), ("a.", "a.*", True), ("a+b", "a+b", True), ("aab", "a+b", False),
]
MESSAGES = "seq long, exchange string, routing_key string, headers map<string,string>"
BINDINGS = "exchange string, queue string, binding_key string, headers map<string,string>, match_all boolean"


@pytest.fixture(params=[200, 0], ids=["inline", "joined"])
def inline(request, monkeypatch):
    monkeypatch.setattr(routing, "INLINE", request.param)


def test_topic_patterns(spark, inline):
    messages = spark.createDataFrame([(i, "x", k, None) for i, (k, _, _) in enumerate(TOPICS)] + [(90, "x", None, None), (91, "y", "order", None)], MESSAGES)
    bindings = spark.createDataFrame([("x", p, p, None, None) for p in sorted({p for _, p, _ in TOPICS})], BINDINGS)
    got = {(r["seq"], r["queue"]) for r in routing.route(messages, bindings, "topic").collect()}
    for i, (_, pattern, matches) in enumerate(TOPICS):
        assert ((i, pattern) in got) == matches, TOPICS[i]
    assert 91 not in {s for s, _ in got}


def test_null_keys_match_no_pattern(spark, inline):
    messages = spark.createDataFrame([(90, "x", None, None), (91, "x", "", None), (92, None, "a", None)], MESSAGES)
    bindings = spark.createDataFrame([("x", p, p, None, None) for p in ("#", "*", "#.#", "a")], BINDINGS)
    assert rows(routing.route(messages, bindings, "topic").select("seq", "queue")) == [(91, "#"), (91, "#.#"), (91, "*")]


def test_one_copy_per_queue(spark, inline):
    messages = spark.createDataFrame([(1, "x", "order.created", None), (2, "x", "user", None)], MESSAGES)
    bindings = spark.createDataFrame([("x", "q1", "order.*", None, None), ("x", "q1", "order.#", None, None), ("x", "q2", "user", None, None), ("x", "q2", "user", None, None)], BINDINGS)
    assert rows(routing.route(messages, bindings, "topic").select("seq", "queue")) == [(1, "q1"), (2, "q2")]
    assert rows(routing.route(messages, bindings, "direct").select("seq", "queue")) == [(2, "q2")]
    assert rows(routing.route(messages, bindings, "fanout").select("seq", "queue")) == [(1, "q1"), (1, "q2"), (2, "q1"), (2, "q2")]


def test_headers(spark, inline):
    messages = spark.createDataFrame(
        [(1, "h", "", {"format": "pdf", "type": "report"}), (2, "h", "", {"format": "csv"}), (3, "h", "", {}), (4, "h", "", None)], MESSAGES
    )
    bindings = spark.createDataFrame(
        [("h", "all", "", {"format": "pdf", "type": "report"}, True), ("h", "any", "", {"format": "csv", "type": "report"}, False), ("h", "every", "", {}, True), ("h", "without", "", {"type": ""}, True)], BINDINGS
    )
    got = rows(routing.route(messages, bindings, "headers").select("seq", "queue"))
    assert got == sorted([(1, "all"), (1, "any"), (2, "any"), (2, "without"), (3, "without"), (4, "without"), *((i, "every") for i in (1, 2, 3, 4))], key=repr)


def test_routing_nothing(spark, inline):
    none = spark.createDataFrame([], BINDINGS)
    for kind in ("topic", "direct", "fanout", "headers"):
        assert routing.route(spark.createDataFrame([(1, "x", "a", None)], MESSAGES), none, kind).count() == 0


def test_queue_order_and_capacity(spark):
    rng = random.Random(2)
    data = [(i, rng.choice("aab"), rng.randrange(10)) for i in range(200)]
    df = spark.createDataFrame(data, "seq long, topic string, lvl int").repartition(3)
    for queue in "ab":
        own = sorted(((-lvl, i) for i, q, lvl in data if q == queue))
        got = {r["seq"]: r["pos"] for r in queueing.drain(df).where(F.col("topic") == queue).collect()}
        assert got == {i: k + 1 for k, (_, i) in enumerate(own)}
        assert [r["seq"] for r in queueing.head(df, 3).where(F.col("topic") == queue).orderBy("pos").collect()] == [i for _, i in own[:3]]
    ten = spark.createDataFrame([(i, "q", 5) for i in range(10)], "seq long, topic string, lvl int")
    assert rows(queueing.spilled(ten, 4).where("spilled").select("seq")) == [(i,) for i in range(4, 10)]


def test_every_message_is_in_one_bucket(spark):
    from tallylog.plans.base import AS_OF, messages
    from tallylog.plans.scalars import state_of
    from tests.conftest import DATA

    m = messages(spark, str(DATA / "sf0.001"))
    assert m.count() == m.withColumn("s", state_of(AS_OF)).where(F.col("s").isin("ready", "delayed", "dead", "expired", "future")).count()


def test_counters_restart_at_sets(spark):
    rng = random.Random(4)
    data = [(i, rng.choice([1, 1, 2]), rng.choice([kv.SET, kv.DEL, kv.INCR, kv.INCR, kv.GET]), rng.randrange(9)) for i in range(300)]
    ops = spark.createDataFrame(data, "seq long, key long, op string, k int")
    state, last, want, got = {}, {}, [], []
    for i, key, op, k in data:
        if op == kv.INCR:
            state[key] = state.get(key, 0) + k
            want.append((i, key, state[key]))
        elif op in (kv.SET, kv.DEL):
            state[key] = k if op == kv.SET else 0
            last[key] = k if op == kv.SET else None
        else:
            got.append((i, key, last.get(key)))
    assert rows(kv.increments(ops)) == sorted(want, key=repr)
    assert rows(kv.gets(ops)) == sorted(got, key=repr)


@pytest.mark.parametrize("pattern,hits", [("", "abc ab* b_"), ("*", "abc ab* b_"), ("ab*", "abc ab*"), ("*c", "abc"), ("*b*", "abc ab* b_"), ("a*c", ""), ("abc", "abc"), ("b_", "b_")])
def test_globs(spark, pattern, hits):
    keys = spark.createDataFrame([(k,) for k in ("abc", "ab*", "b_")], "k string")
    assert {r["k"] for r in keys.where(S.glob_match(pattern, F.col("k"))).collect()} == set(hits.split())


def test_streaks(spark):
    series = spark.createDataFrame(list(enumerate([0, 5, 6, 0, 7, 0, 8, 9, 9])), "h long, n long")
    assert rows(stats.streaks(series, "h", F.col("n") > 3, 2)) == [(1, 2, 2), (6, 8, 3)]


def test_log_codec_stops_at_damage():
    records = [(1, b"{}"), (2, b"id"), (1, b"x" * 100_000), (2, b"")]
    raw = b"".join(wal.encode(*r) for r in records)
    assert list(wal.decode(io.BytesIO(raw))) == records
    assert list(wal.decode(io.BytesIO(raw[:-1]))) == records[:3]
    damaged = bytearray(raw)
    damaged[len(wal.encode(*records[0])) + 9] ^= 1
    assert list(wal.decode(io.BytesIO(bytes(damaged)))) == records[:1]
    assert list(wal.decode(io.BytesIO(b"\0" * 100))) == [] == list(wal.decode(io.BytesIO(b"")))


def test_log_source(spark, tmp_path):
    ship(spark)
    wal.register(spark)
    assert spark.read.format("wal").load(str(tmp_path)).count() == 0
    df = spark.createDataFrame([(1, b"a"), (2, b"b"), (2, b"")], "rec_type int, data binary").coalesce(1)
    df.write.format("wal").mode("append").save(str(tmp_path / "log"))
    read = lambda: [(r["seq"], r["rec_type"], bytes(r["data"])) for r in spark.read.format("wal").load(str(tmp_path / "log")).orderBy("segment", "seq").collect()]
    assert read() == [(0, 1, b"a"), (1, 2, b"b"), (2, 2, b"")]
    more = spark.createDataFrame([(3, b"c")], "rec_type int, data binary").coalesce(1)
    more.write.format("wal").mode("append").save(f"file://{tmp_path}/log")
    assert read() == [(0, 1, b"a"), (1, 2, b"b"), (2, 2, b""), (0, 3, b"c")]
    more.write.format("wal").mode("overwrite").save(str(tmp_path / "log"))
    assert read() == [(0, 3, b"c")]


def test_snapshot_and_load(spark, tmp_path):
    made = generator.load(spark, 1000, queues=3)
    assert made.where("delay_ns > 0").count() == 200 and made.select("msg_id").distinct().count() == 1000
    snapshots.write_snapshot(made.withColumn("bucket", F.lit("ready")), str(tmp_path / "s"))
    assert snapshots.read_snapshot(spark, str(tmp_path / "s")).count() == 1000


def test_unanswered_deliveries_time_out(spark, tmp_path):
    """Timers retry a message once per timeout and end it as dead; an answer in time stops them."""
    ship(spark)
    start = datetime(2024, 1, 1)
    ms = lambda s: int((start + timedelta(seconds=s) - datetime(1970, 1, 1)).total_seconds() * 1000)
    batches = [[(1, 1, "publish", 0), (2, 2, "publish", 0), (2, 3, "ack", 5)], [(3, 4, "publish", 100)], [(3, 5, "ack", 101)], [(4, 6, "publish", 300)]]
    for i, batch in enumerate(batches):
        data = [(k, seq, op, ms(s), start + timedelta(seconds=s)) for k, seq, op, s in batch]
        spark.createDataFrame(data, "key long, seq long, op string, at_ms long, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    source = spark.readStream.schema("key long, seq long, op string, at_ms long, at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(str(tmp_path / "out" / f"n={number}"))

    run_to_end(jobs.lifecycles(source, 1, timeout_ms=30_000, late="1 second"), str(tmp_path / "x"), str(tmp_path / "c"), mode="update", each=keep)
    found = spark.read.parquet(str(tmp_path / "out"))
    last = {r["key"]: (r["s"]["state"], r["s"]["retry"]) for r in found.groupBy("key").agg(F.max_by(F.struct("state", "retry"), F.struct("batch", "retry")).alias("s")).collect()}
    assert last[1] == ("dead", 2) and last[2] == ("acked", 0) and last[3] == ("acked", 0) and last[4][0] == "ready"


def test_frames(spark):
    data = [(1, b"{}"), (3, b""), (255, b"x" * 1000)]
    raw = b"".join(frames.encode(*f) for f in data)
    assert list(frames.decode(io.BytesIO(raw))) == data and list(frames.decode(io.BytesIO(raw[:-1]))) == data[:2]
    assert list(frames.decode(io.BytesIO(frames.encode(1, b"x" * (S.MAX_FRAME_BYTES + 1))))) == []
    got = frames.named(spark.createDataFrame(data, "command int, payload binary")).orderBy("command").collect()
    assert [r["name"] for r in got] == ["publish", "consume", None]


def test_a_stopped_stream_goes_on(spark, tmp_path):
    """Ticks pick up what arrives; after a restart nothing is lost or doubled."""
    put = lambda i: spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put(0)
    stream = lambda: spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    for i in (1, 2):
        query = jobs.keep_running(stream(), str(tmp_path / "out"), str(tmp_path / "check"), "200 milliseconds")
        put(i)
        query.processAllAvailable()
        query.stop()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == sorted(((i,) for i in range(30)), key=repr)


def test_late_and_repeated_commands_of_a_stream(spark, tmp_path):
    """A rejection that comes a batch before its publish counts; a command that comes again doesn't."""
    start = datetime(2024, 1, 1)
    batches = [[(1, 2, "nack", 5)], [(1, 1, "publish", 0), (1, 2, "nack", 5)], [(1, 3, "ack", 9)], [(1, 3, "ack", 9), (2, 4, "publish", 500)], [(1, 1, "publish", 0)]]
    for i, batch in enumerate(batches):
        data = [(k, seq, op, int((start - datetime(1970, 1, 1)).total_seconds() + s) * 1000, start + timedelta(seconds=s)) for k, seq, op, s in batch]
        spark.createDataFrame(data, "key long, seq long, op string, at_ms long, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    source = spark.readStream.schema("key long, seq long, op string, at_ms long, at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(str(tmp_path / "out" / f"n={number}"))

    run_to_end(jobs.lifecycles(source, 2, late="1 minute"), str(tmp_path / "x"), str(tmp_path / "c"), mode="update", each=keep)
    found = spark.read.parquet(str(tmp_path / "out")).where("key = 1").orderBy("batch").collect()
    assert [(r["state"], r["retry"]) for r in found][:4] == [("none", 0), ("ready", 1), ("acked", 1), ("acked", 1)] and (found[-1]["state"], found[-1]["retry"]) == ("acked", 1)


def test_many_bindings_on_a_stream(spark, tmp_path):
    data = [(i, "x", k, {"a": k}) for i, k in enumerate(("order.new", "user", None, "order.\\E.vn", "q300"))]
    spark.createDataFrame(data, MESSAGES).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(MESSAGES).parquet(str(tmp_path / "in"))
    patterns = [f"q{i}" for i in range(301)] + ["order.#", "#", "order.\\E.*"]
    many = spark.createDataFrame([("x", p, p, {"a": p}, True) for p in patterns], BINDINGS)
    for kind in ("topic", "direct", "fanout", "headers"):
        run_to_end(jobs.fan_out(stream(), many, kind), str(tmp_path / kind), str(tmp_path / f"c{kind}"))
        got = rows(spark.read.parquet(str(tmp_path / kind)).select("seq", "queue"))
        assert got == rows(routing.route(spark.createDataFrame(data, MESSAGES), many, kind).select("seq", "queue"))
        assert len(got) == {"topic": 8, "direct": 1, "fanout": 5 * len(patterns), "headers": 1}[kind]


@pytest.mark.parametrize("ranges", [1, 5])
def test_bounded_counters(spark, ranges):
    rng = random.Random(ranges)
    data = [(rng.choice("aab"), i, rng.choice([1, 1, -1, -1, 2, None])) for i in range(400)]
    state, want = {"a": 0, "b": 0}, []
    for key, i, step in data:
        full = state[key] + (step or 0)
        state[key] = min(3, max(0, full))
        want.append((key, i, state[key], state[key] != full))
    df = spark.createDataFrame(data, "key string, seq long, step int").repartition(4)
    assert rows(walks.bounded(df, "key", "seq", F.col("step"), 0, 3, ranges)) == sorted(want, key=repr)
    assert rows(walks.bounded(df.limit(0), "key", "seq", F.col("step"), 0, 3)) == []
    clash = df.select("*", F.lit(1).alias("__step"), F.lit(2).alias("value"))
    assert walks.bounded(clash, "key", "seq", F.col("step"), 0, 3, ranges).count() == 400


def test_a_message_at_its_limit_is_alive(spark):
    """The limit says how often a message may be tried again: one more is dead."""
    got = spark.createDataFrame([(4, 5), (5, 5), (6, 5), (0, 0), (1, 0)], "retry int, most int").select("retry", "most", S.is_dead(F.col("retry"), F.col("most")).alias("dead"))
    assert [r["dead"] for r in got.collect()] == [False, False, True, False, True]
