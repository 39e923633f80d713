"""Queries that run a broker of their own: a command table, a load, a stream that is stopped and resumed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallylog.log import MessageLog
from tallylog.plans.base import EV, MSG, Plans, messages
from tallylog.session import fresh_dir
from tallylog.sources import generator
from tallylog.sources.tables import table
from tallylog.streaming.dedup import run_to_end

P = Plans()

_SECOND = 1_000_000_000
#: Messages per queue that a consumer polls for at a time.
_POLL = 3
#: What is published: the first row of each message, in its topic's queue.
_FIRST = f"{MSG}, f as (select topic as queue, msg_id, lvl, seq from (select *, row_number() over (partition by msg_id order by seq) as rn from msg where msg_id is not null and topic <> '') where rn = 1)"


def _published(spark, d):
    """A broker with the messages in the order of their rows."""
    m = messages(spark, d).where(F.col("msg_id").isNotNull() & (F.col("topic") != ""))
    first = m.groupBy("msg_id").agg(F.min_by(F.struct("seq", "topic", "priority"), "seq").alias("m"))
    broker = MessageLog(spark, fresh_dir(spark, "broker"), max_retry=1)
    rows = first.select(F.col("m.seq").alias("seq"), F.col("m.topic").alias("queue"), "msg_id", F.col("m.priority").alias("priority"))
    broker.publish(rows.orderBy("seq").drop("seq"), _SECOND)
    return broker


@P.add(f"with {_FIRST}, n as (select queue, count(*) as n from f group by 1) select queue, case when n > {2 * _POLL} then {2 * _POLL} else n end as acked, greatest(n - {2 * _POLL}, 0) as ready from n")
def log_batch_poll(spark, d):
    """A consumer that polls twice for some messages of each queue and acknowledges each batch."""
    broker = _published(spark, d)
    for at in (2, 3):
        broker.process(lambda batch: None, _POLL, at * _SECOND)
    states = broker.states(4 * _SECOND)
    return states.groupBy("queue").agg(F.count_if(F.col("state") == "acked").alias("acked"), F.count_if(F.col("state") == "ready").alias("ready"))


@P.add(f"""with {_FIRST}, r as (select queue, row_number() over (partition by queue order by lvl desc, seq) as pos from f)
  select queue, count(*) filter (where pos <= {_POLL}) as dead, count(*) filter (where pos > {_POLL}) as ready from r group by 1""")
def log_tick(spark, d):
    """The scheduler's turns: unanswered deliveries go back, and after the last retry to the dead letters."""
    broker = _published(spark, d)
    for at in (2, 40):
        broker.consume(_POLL, at * _SECOND)
        broker.tick((at + 31) * _SECOND, compact_above=1)
    states = broker.states(100 * _SECOND)
    return states.groupBy("queue").agg(F.count_if(F.col("state") == "dead").alias("dead"), F.count_if(F.col("state") == "ready").alias("ready"))


@P.add("""select 'queue.' || i % 10 as topic, count(*) as messages, count(*) filter (where i % 5 = 0) as delayed, min(md5(cast(i as varchar))) as first_id, cast(max(i) * 1000000 as bigint) as last_ns
  from range(10000) t(i) group by 1""")
def generated_load(spark, d):
    made = generator.load(spark, 10_000)
    delayed = F.count_if(F.col("delay_ns") > 0)
    return made.groupBy("topic").agg(F.count("*").alias("messages"), delayed.alias("delayed"), F.min("msg_id").alias("first_id"), F.max("ts_ns").alias("last_ns"))


@P.add(f"with {EV} select op, count(*) as n, count(distinct seq) as seqs from ev group by 1")
def stream_resumed(spark, d):
    """A stream that is stopped after the first half of its input, and goes on where it stopped: nothing lost, nothing twice."""
    work = fresh_dir(spark, "resumed")
    rows = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("op"))
    for half in (0, 1):
        rows.where(F.pmod("seq", F.lit(2)) == half).write.mode("append").parquet(f"{work}/in")
        run_to_end(spark.readStream.schema("seq bigint, op string").parquet(f"{work}/in"), f"{work}/out", f"{work}/checkpoint")
    done = spark.read.schema("seq bigint, op string").parquet(f"{work}/out")
    return done.groupBy("op").agg(F.count("*").alias("n"), F.countDistinct("seq").alias("seqs"))
