"""What the query modules share: a registry, and the logs as both engines read them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.functions.ids import canonical_id
from tallylog.functions.scalars import clamp_priority
from tallylog.sources.tables import table

#: Instants that queries are evaluated at, in ns: 2018-01-15 for messages, 2024-01-16 for events (UTC).
AS_OF = 1_515_974_400_000_000_000
AS_OF_EVENTS = 1_705_363_200_000_000_000


class Plans:
    """Queries of one module and their SQL twins."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable:
        def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep


def zero(name: str):
    return F.coalesce(F.col(name), F.lit(0)).alias(name)


def messages(spark: SparkSession, d: str, every: bool = False) -> DataFrame:
    """The delivery log; missing counters are 0. Rows without topic or publish time have no place in a queue and are
    left out, but for queries about ids, which take every row."""
    rows = table(spark, d, "messages")
    return (
        (rows if every else rows.where(F.col("topic").isNotNull() & F.col("timestamp_ns").isNotNull()))
        .select(
            F.col("row_id").alias("seq"), canonical_id("id").alias("msg_id"), "topic", F.coalesce("exchange_name", F.lit("")).alias("exchange"),
            "routing_key", "payload", "headers", F.col("timestamp_ns").alias("ts_ns"), zero("retry"), F.coalesce("max_retry", F.lit(5)).alias("max_retry"),
            zero("delivery_count"), zero("delay_ns"), zero("ttl_ns"), zero("deliver_at"), zero("expires_at"), zero("priority"),
            clamp_priority(F.coalesce("priority", F.lit(0))).alias("lvl"), "received_at",
        )
    )


MSG = """msg as (select row_id as seq, nullif(lower(trim(id, ' ')), '') as msg_id, topic, coalesce(exchange_name, '') as exchange, routing_key,
  payload, headers, timestamp_ns as ts_ns, coalesce(retry, 0) as retry, coalesce(max_retry, 5) as max_retry, coalesce(delivery_count, 0) as delivery_count,
  coalesce(delay_ns, 0) as delay_ns, coalesce(ttl_ns, 0) as ttl_ns, coalesce(deliver_at, 0) as deliver_at, coalesce(expires_at, 0) as expires_at,
  coalesce(priority, 0) as priority, cast(least(greatest(coalesce(priority, 0), 0), 9) as int) as lvl, received_at
  from messages where topic is not null and timestamp_ns is not null)"""


EVERY = MSG.replace(" where topic is not null and timestamp_ns is not null", "")


def commands(spark: SparkSession, d: str) -> DataFrame:
    """The replicated log as committed: per index the entry of the highest term, as first shipped."""
    raw = table(spark, d, "raft_commands").where(F.col("log_index").isNotNull())
    entry = F.struct("cmd_type", canonical_id("message_id").alias("msg_id"), "topic", "subscriber_id", "exchange_name", "exchange_type", "queue_name", "binding_key", "applied_at")
    return raw.groupBy(F.col("log_index").alias("seq")).agg(F.max_by(entry, F.struct("term", -F.col("cmd_row"))).alias("e")).select("seq", "e.*")


CMD = """cmd as (select log_index as seq, cmd_type, nullif(lower(trim(message_id, ' ')), '') as msg_id, topic, subscriber_id, exchange_name, exchange_type,
  queue_name, binding_key, applied_at from (select *, row_number() over (partition by log_index order by term desc nulls last, cmd_row) as rn
  from raft_commands where log_index is not null) where rn = 1)"""


_NEVER = 9223372036854775807
#: Lives of messages in the replicated log: inserts that took effect, with what ended them; needs `with recursive` and CMD.
LIVES = f"""i as (select c.msg_id, c.topic, c.seq as start, coalesce((select min(p.seq) from cmd p where p.cmd_type = 7 and p.topic = c.topic and p.seq > c.seq), {_NEVER}) as purge,
    coalesce((select min(a.seq) from cmd a where a.cmd_type = 2 and a.msg_id = c.msg_id and a.seq > c.seq), {_NEVER}) as ack from cmd c where c.cmd_type = 1 and c.msg_id is not null),
  nx as (select a.*, least(purge, ack) as stop, (select min(b.start) from i b where b.msg_id = a.msg_id and b.start > least(a.purge, a.ack)) as nxt from i a),
  life as (select nx.* from nx join (select msg_id, min(start) as start from i group by 1) f on f.msg_id = nx.msg_id and f.start = nx.start
    union all select nx.* from life join nx on nx.msg_id = life.msg_id and nx.start = life.nxt)"""


def wal(spark: SparkSession, d: str) -> DataFrame:
    """The brokers' logs, each record once, as first shipped."""
    raw = table(spark, d, "wal_records").where(F.col("node_id").isNotNull() & F.col("lsn").isNotNull())
    entry = F.struct("rec_type", canonical_id("msg_id").alias("msg_id"), "topic", "payload", "priority", "retry", "metadata", "logged_at", "rec_id")
    return raw.groupBy("node_id", "lsn").agg(F.min_by(entry, "rec_id").alias("e")).select("node_id", "lsn", "e.*")


WAL = """wal as (select node_id, lsn, rec_type, nullif(lower(trim(msg_id, ' ')), '') as msg_id, topic, payload, priority, retry, metadata, logged_at, rec_id
  from (select *, row_number() over (partition by node_id, lsn order by rec_id) as rn from wal_records where node_id is not null and lsn is not null) where rn = 1)"""


def events(spark: SparkSession, d: str) -> DataFrame:
    """The event log as commands of connections: seq, op, key, k, times in ns."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("op"), F.col("user_id").alias("key"), k.alias("k"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"), "ts",
        F.when(F.col("event_id") % 5 == 0, F.lit(432_000_000_000_000)).otherwise(F.lit(0)).cast("long").alias("ttl_ns"),
        (F.col("event_id") % 8).alias("nacks"),
    )


EV = """ev as (select event_id as seq, event_type as op, user_id as key, cast(json_extract_string(props, '$.k') as int) as k, epoch_us(ts) * 1000 as ts_ns, ts,
  case when event_id % 5 = 0 then cast(432000000000000 as bigint) else cast(0 as bigint) end as ttl_ns, event_id % 8 as nacks from events)"""
