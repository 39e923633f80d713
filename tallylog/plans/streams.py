"""Queries that run a stream to its end, and the binary log's round trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallylog.functions import envelope
from tallylog.functions.ids import canonical_id
from tallylog.functions.scalars import is_dead
from tallylog.plans.base import EV, EVERY, MSG, Plans, messages
from tallylog.plans.queues import _SHAPE, _TOPIC, _TOPIC_HITS, _TOPIC_RE, bindings
from tallylog.session import fresh_dir, ship
from tallylog.sources import wal as wal_source
from tallylog.sources.snapshots import read_snapshot, write_snapshot
from tallylog.sources.tables import table
from tallylog.streaming import jobs
from tallylog.streaming.dedup import first_sightings, run_to_end

P = Plans()


def _drained(spark, stream, what, schema):
    work = fresh_dir(spark, what)
    run_to_end(stream, f"{work}/out", f"{work}/checkpoint")
    return spark.read.schema(schema).parquet(f"{work}/out")


@P.add("""select start, event_type, n from (select time_bucket(interval 5 minute, ts) as start, event_type, count(*) as n from events group by 1, 2)
  where start + interval 5 minute <= (select date_trunc('milliseconds', max(ts)) - interval 10 minute from events)""")
def stream_rates(spark, d):
    """Closed five-minute windows; those the watermark hasn't passed are withheld."""
    return _drained(spark, jobs.rates(jobs.arriving(spark, d, "events"), "ts", "event_type"), "rates", "start timestamp, event_type string, n bigint").withColumn("start", F.col("start").cast("timestamp_ntz"))


@P.add(f"with {_TOPIC_HITS} select queue, count(*) as depth from hits group by 1")
def stream_fanout(spark, d):
    stream = jobs.arriving(spark, d, "messages").where(F.col("topic").isNotNull() & F.col("timestamp_ns").isNotNull())
    rows = stream.select(F.col("row_id").alias("seq"), F.coalesce("exchange_name", F.lit("")).alias("exchange"), "routing_key", "headers")
    routed = jobs.fan_out(rows, bindings(spark, "topic"), "topic").select("seq", "queue")
    return _drained(spark, routed, "fanout", "seq bigint, queue string").groupBy("queue").agg(F.count("*").alias("depth"))


@P.add(f"with {EVERY} select distinct msg_id from msg where msg_id is not null and received_at is not null")
def stream_dedup(spark, d):
    """Identifiers as the keyed store lets them through; it keeps them for two days, and what comes again after that is
    settled among what it let through."""
    rows = jobs.arriving(spark, d, "messages").where(F.col("received_at").isNotNull())
    ids = rows.select(canonical_id("id").alias("msg_id"), "received_at").where(F.col("msg_id").isNotNull())
    return _drained(spark, first_sightings(ids, ["msg_id"], "received_at", "2 days").select("msg_id"), "ids", "msg_id string").distinct()


#: More bindings than are compiled into a plan.
_MANY = [(_TOPIC, f"q_{i:03d}", p, None, None) for i in range(100) for p in (f"order.*.{'vn' if i % 2 else 'us'}", f"#.k{i}", f"{'stock' if i % 3 else 'user'}.#")]
_MANY_SQL = ", ".join(f"('{e}', '{q}', '{k}')" for e, q, k, _, _ in _MANY)


@P.add(f"""with {MSG}, b(exchange, queue, binding_key) as (values {_MANY_SQL}), k as (select exchange, routing_key, count(*) as n from msg where exchange = '{_TOPIC}' group by all),
  hits as (select distinct k.exchange, routing_key, n, queue from k join b using (exchange) where regexp_matches('.' || routing_key, {_TOPIC_RE})) select queue, cast(sum(n) as bigint) as depth from hits group by 1""")
def stream_fanout_many(spark, d):
    """Three hundred bindings on a stream."""
    stream = jobs.arriving(spark, d, "messages").where(F.col("topic").isNotNull() & F.col("timestamp_ns").isNotNull())
    rows = stream.select(F.col("row_id").alias("seq"), F.coalesce("exchange_name", F.lit("")).alias("exchange"), "routing_key", "headers")
    routed = jobs.fan_out(rows, spark.createDataFrame(_MANY, _SHAPE), "topic").select("seq", "queue")
    return _drained(spark, routed, "fanout-many", "seq bigint, queue string").groupBy("queue").agg(F.count("*").alias("depth"))


@P.add(f"with {EV} select seq, key, ts_ns // 1000000 + 30000 as deadline_ms from ev where op = 'view'")
def stream_pending(spark, d):
    """Deliveries as they happen, each with when its answer is due: what a blocking consume leaves pending."""
    e = jobs.arriving(spark, d, "events").where(F.col("event_type") == "view")
    pending = e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), (F.unix_millis(F.col("ts").cast("timestamp")) + 30_000).alias("deadline_ms"))
    return _drained(spark, pending, "pending", "seq bigint, key bigint, deadline_ms bigint")


_OPS = {"signup": "publish", "purchase": "ack", "error": "nack"}


@P.add(f"""with {EV}, p as (select key, max(seq) as pub from ev where op = 'signup' group by 1),
  t as (select ev.key, pub, seq, op, min(case when op = 'purchase' then seq end) over (partition by ev.key) as ack from ev join p on ev.key = p.key where seq > pub and op in ('purchase', 'error')),
  n as (select p.key, count(seq) filter (where op = 'error' and (ack is null or seq < ack)) as nacks, max(ack) as ack from p left join t on p.key = t.key group by 1)
  select key, case when nacks > 2 then 'dead' when ack is not null then 'acked' else 'ready' end as state, cast(least(nacks, 3) as int) as retry from n""")
def stream_lifecycle(spark, d):
    """Where each key's last published message ended, by a stateful processor over the command stream (two retries)."""
    ship(spark)
    e = jobs.arriving(spark, d, "events").where(F.col("event_type").isin(*_OPS))
    op = F.element_at(F.create_map(*[F.lit(x) for kv in _OPS.items() for x in kv]), F.col("event_type"))
    commands = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), op.alias("op"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.col("ts").cast("timestamp").alias("at"))
    work = fresh_dir(spark, "lifecycle")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{work}/out/batch={number}")

    run_to_end(jobs.lifecycles(commands, 2), f"{work}/out", f"{work}/checkpoint", mode="update", each=keep)
    updates = spark.read.schema("key bigint, seq bigint, state string, retry int").parquet(f"{work}/out")
    last = updates.groupBy("key").agg(F.max_by(F.struct("state", "retry"), "seq").alias("s"))
    return last.where(F.col("s.state") != "none").select("key", "s.state", "s.retry")


def _records(spark, d):
    """(rec_type, data) as the brokers write them: a publish's whole message, an acknowledgement's id, metadata as it is."""
    body = F.to_json(F.struct(F.col("msg_id").alias("id"), "topic", "payload", "priority", "retry"))
    content = F.when(F.col("rec_type") == 1, body).when(F.col("rec_type") == 2, F.coalesce("msg_id", F.lit(""))).otherwise(F.coalesce("metadata", F.lit("")))
    return table(spark, d, "wal_records").where(F.col("rec_type").between(1, 6)).select("rec_type", F.encode(content, "UTF-8").alias("data"))


@P.add("""select rec_type, case rec_type when 1 then msg_id when 2 then coalesce(msg_id, '') end as id, case when rec_type = 1 then topic end as topic, case when rec_type = 1 then payload end as payload,
  case when rec_type = 1 then priority end as priority, case when rec_type = 1 then retry end as retry, case when rec_type > 2 then coalesce(metadata, '') end as metadata, count(*) as n
  from wal_records where rec_type between 1 and 6 group by all""")
def wal_binary_roundtrip(spark, d):
    """The whole log written as binary segments and read again."""
    ship(spark)
    wal_source.register(spark)
    path = fresh_dir(spark, "segments")
    _records(spark, d).write.format("wal").mode("append").save(path)
    text, kind = F.decode("data", "UTF-8"), F.col("rec_type")
    back = spark.read.format("wal").load(path).withColumn("m", envelope.decode(F.when(kind == 1, text)))
    fields = back.select(
        kind, F.when(kind == 1, F.col("m.id")).when(kind == 2, text).alias("id"), "m.topic", "m.payload", "m.priority", "m.retry", F.when(kind > 2, text).alias("metadata")
    )
    return fields.groupBy(*fields.columns).agg(F.count("*").alias("n"))


@P.add("select rec_type, count(*) as n from wal_records where rec_type between 1 and 6 group by 1")
def wal_append_twice(spark, d):
    """A log written by two appends, one after the other, holds both."""
    ship(spark)
    wal_source.register(spark)
    path = fresh_dir(spark, "segments")
    for kinds in ((1, 3, 5), (2, 4, 6)):
        _records(spark, d).where(F.col("rec_type").isin(*kinds)).write.format("wal").mode("append").save(path)
    return spark.read.format("wal").load(path).groupBy("rec_type").agg(F.count("*").alias("n"))


@P.add(f"with {MSG} select case when retry > max_retry then 'dead' else 'active' end as bucket, topic, count(*) as n from msg group by all")
def snapshot_roundtrip(spark, d):
    path = fresh_dir(spark, "snapshot")
    bucket = F.when(is_dead(F.col("retry"), F.col("max_retry")), "dead").otherwise("active")
    write_snapshot(messages(spark, d).select(bucket.alias("bucket"), "topic", "seq"), path)
    return read_snapshot(spark, path).groupBy("bucket", "topic").agg(F.count("*").alias("n"))
