"""A broker's life through the command table."""

import pytest
from pyspark.sql import functions as F

from tallylog.log import MessageLog
from tests.conftest import rows

S = 1_000_000_000


@pytest.fixture
def log(spark, tmp_path):
    return MessageLog(spark, str(tmp_path / "log"), max_retry=1)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "msg_id string")


def states(log, at):
    return {r["msg_id"]: r["state"] for r in log.states(at).collect()}


def test_priorities_answers_and_dead_letters(spark, log):
    assert states(log, S) == {} and log.storage_size() == 0 and rows(log.stats(S)) == []
    log.publish(spark.createDataFrame([("q", f"m{p}", p) for p in (0, 5, 9, 3)] + [("", "bad", 1), (None, "bad", 1), ("q", None, 1)], "queue string, msg_id string, priority int"), S)
    log.publish(ids(spark, "m5").withColumn("queue", F.lit("q")), 2 * S)  # a repeat
    assert rows(log.next_messages(3 * S)) == [("q", "m9")]
    assert [r["msg_id"] for r in log.consume(2, 3 * S).collect()] == ["m9", "m5"]
    log.ack(ids(spark, "m9"), 4 * S)
    log.nack(ids(spark, "m5"), 4 * S)
    assert states(log, 5 * S) == {"m9": "acked", "m5": "ready", "m3": "ready", "m0": "ready"}
    assert states(log, 3 * S) == {"m9": "pending", "m5": "pending", "m3": "ready", "m0": "ready"}
    log.consume(1, 6 * S)
    assert rows(log.timed_out(20 * S).select("msg_id")) == [] and rows(log.timed_out(40 * S).select("msg_id")) == [("m5",)]
    log.requeue_timed_out(40 * S)
    assert rows(log.dead_letters(41 * S).select("queue", "msg_id", "retry")) == [("q_dead_letter", "m5", 2)]
    log.purge("q", 42 * S)
    assert states(log, 43 * S) == {"m9": "acked", "m5": "dead", "m3": "purged", "m0": "purged"}
    before = rows(log.states(43 * S).where(F.col("state") == "dead").drop("headers"))
    log.checkpoint(43 * S)
    assert states(log, 43 * S) == {"m5": "dead"} and rows(log.states(43 * S).drop("headers")) == before
    log.purge_dead_letters("q", 44 * S)
    assert states(log, 45 * S) == {"m5": "purged"}


def test_delay_and_expiry(spark, log):
    log.publish(spark.createDataFrame([("q", "late", 10 * S, 0), ("q", "short", 0, 10 * S), ("q", "early", 10 * S, 0)], "queue string, msg_id string, delay_ns long, ttl_ns long"), 0)
    log.promote(ids(spark, "early"), S)
    assert states(log, 5 * S) == {"late": "delayed", "short": "ready", "early": "ready"}
    assert states(log, 10 * S) == {"late": "ready", "short": "ready", "early": "ready"}
    assert states(log, 11 * S)["short"] == "expired"
    assert rows(log.has_messages(ids(spark, "late", "short", "x"), 11 * S)) == [("late",)]


def test_exchanges_and_topics(spark, log):
    log.declare_exchange("t", "topic", 1)
    log.declare_exchange("t", "direct", 1)
    log.declare_exchange("f", "fanout", 1)
    log.bind("t", "q1", "order.*", 2)
    log.bind("t", "q1", "order.#", 2)
    log.bind("t", "q2", "#", 2)
    log.unbind("t", "q2", "#", 3)
    log.bind("f", "q3", "", 3)
    log.delete_exchange("f", 4)
    with pytest.raises(ValueError):
        log.delete_exchange("", 4)
    assert rows(log.exchanges()) == [("t", "topic")]
    data = [("t", "order.new", "a"), ("t", "user", "b"), (None, "q9", "c"), ("f", "x", "d"), ("nowhere", "x", "e")]
    log.publish_exchange(spark.createDataFrame(data, "exchange string, routing_key string, msg_id string").withColumn("headers", F.lit(None).cast("map<string,string>")), 5)
    assert rows(log.ready(6).select("queue")) == [("q1",), ("q9",)]
    log.subscribe("news", "s1", 7)
    log.publish_topic(ids(spark, "n1").withColumn("queue", F.lit("news")), 8)
    log.subscribe("news", "s2", 9)
    log.publish_topic(ids(spark, "n2").withColumn("queue", F.lit("news")), 10)
    assert rows(log.inbox().select("subscriber", "msg_id")) == [("s1", "n1"), ("s1", "n2"), ("s2", "n2")]
    log.unsubscribe("news", "s1", 11)
    assert rows(log.inbox().select("subscriber", "msg_id")) == [("s2", "n2")]


def test_handlers_answer_for_their_batch(spark, log):
    log.publish(ids(spark, "a", "b").withColumn("queue", F.lit("q")), S)
    seen = []
    assert log.process(lambda df: seen.extend(r["msg_id"] for r in df.collect()), 1, 2 * S)
    assert not log.process(lambda df: 1 / 0, 5, 3 * S)
    assert len(seen) == 1 and sorted(states(log, 4 * S).values()) == ["acked", "ready"]
    assert log.states(4 * S).agg(F.sum("retry")).first()[0] == 1


def test_only_pending_messages_can_be_answered(spark, log):
    log.publish(ids(spark, "a", "b", "c").withColumn("queue", F.lit("q")), S)
    log.nack(ids(spark, "a"), 2 * S)
    log.nack(ids(spark, "a"), 2 * S)
    log.ack(ids(spark, "b", "nowhere"), 2 * S)
    assert set(states(log, 3 * S).values()) == {"ready"}
    log.consume(3, 3 * S)
    log.ack(ids(spark, "a"), 4 * S)
    log.ack(ids(spark, "a"), 5 * S)
    log.nack(ids(spark, "b"), 5 * S)
    log.nack(ids(spark, "b"), 5 * S)
    assert states(log, 6 * S) == {"a": "acked", "b": "ready", "c": "pending"}
    got = rows(log.answers(6 * S).select("msg_id", "op", "accepted"))
    assert got.count(("a", "ack", True)) == 1 and got.count(("a", "ack", False)) == 1 and got.count(("b", "nack", True)) == 1 and sum(not g[2] for g in got) == 6


def test_ticks_send_overdue_deliveries_back_and_compact(spark, log):
    log.publish(ids(spark, "a", "b").withColumn("queue", F.lit("q")), S)
    log.consume(1, 2 * S)
    log.tick(10 * S)
    assert sorted(states(log, 11 * S).values()) == ["pending", "ready"]
    log.tick(40 * S)
    assert set(states(log, 41 * S).values()) == {"ready"} and log.states(41 * S).agg(F.sum("retry")).first()[0] == 1
    before = rows(log.states(41 * S).drop("headers"))
    log.tick(42 * S, compact_above=0)
    log.tick(43 * S)
    assert rows(log.states(43 * S).drop("headers")) == before


def test_batches_of_two_writers_have_numbers_of_their_own(spark, log):
    other = MessageLog(spark, log.path, max_retry=1)
    taken = [w._next_batch() for w in (log, other, log, other)]
    assert taken == [1, 2, 3, 4]
