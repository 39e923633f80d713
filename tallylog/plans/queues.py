"""Queries of queue order, delivery outcomes and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallylog.functions import scalars as S
from tallylog.functions.scalars import is_dead
from tallylog.operators import queueing, routing, walks
from tallylog.operators.changes import message_steps, wal_live
from tallylog.operators.joins import join_salted
from tallylog.operators.ranges import positions, running
from tallylog.plans.base import AS_OF, CMD, EV, EVERY, LIVES, MSG, WAL, Plans, commands, events, messages, wal
from tallylog.plans.scalars import _STATE, state_of
from tallylog.session import fresh_dir, ship
from tallylog.sources import wal as wal_source
from tallylog.sources.tables import table

P = Plans()

#: Per level; the fixture's capacity.
CAPACITY = 64


@P.add(f"with {MSG} select seq, topic, row_number() over (partition by topic order by seq) as pos from msg")
def fifo_dequeue(spark, d):
    return queueing.fifo(messages(spark, d).select("seq", "topic"))


@P.add(f"with {MSG} select * from (select topic, seq, lvl, row_number() over (partition by topic order by lvl desc, seq) as pos from msg) where pos <= 20")
def priority_dequeue(spark, d):
    return queueing.head(messages(spark, d).select("topic", "seq", "lvl"), 20)


@P.add(f"with {MSG} select topic, seq, lvl, row_number() over (partition by topic order by lvl desc, seq) as pos from msg")
def drain_order(spark, d):
    return queueing.drain(messages(spark, d).select("topic", "seq", "lvl"))


@P.add(f"""with recursive {CMD}, {LIVES} select seq, c.topic, count(start) as purged from cmd c left join life on purge = seq and purge < ack where cmd_type = 7 and c.topic is not null group by 1, 2""")
def purge_counts(spark, d):
    """How many messages each purge took out of its queue: those live then, not those acknowledged or purged before."""
    ends = message_steps(table(spark, d, "raft_commands")).where((F.col("kind") == 0) & F.col("live")).groupBy(F.col("pos").alias("seq")).agg(F.count("*").alias("n"))
    purges = commands(spark, d).where((F.col("cmd_type") == 7) & F.col("topic").isNotNull()).select("seq", "topic")
    return purges.join(ends, "seq", "left").select("seq", "topic", F.coalesce("n", F.lit(0)).alias("purged"))


@P.add(f"""with recursive {CMD}, {LIVES}, u as (select c.seq, c.cmd_type, life.start is not null as live from cmd c left join life on life.msg_id = c.msg_id and c.seq > life.start and c.seq <= least(life.purge, life.ack)
    where cmd_type in (2, 3) and c.msg_id is not null), p as (select distinct purge from life where purge < ack),
  x as (select *, lag(cmd_type) over (partition by exchange_name order by seq) as was from cmd where cmd_type in (11, 12) and exchange_name is not null),
  y as (select *, count(*) filter (where cmd_type = 12) over (partition by exchange_name order by seq) as era from x),
  z as (select *, first_value(exchange_type) over (partition by exchange_name, era, cmd_type order by seq) as kind from y)
  select seq, cmd_type, case when cmd_type = 1 then case when msg_id is null then 'invalid' when seq in (select start from life) then 'inserted' else 'repeated' end
    when cmd_type in (2, 3) then case when msg_id is null then 'invalid' when seq in (select seq from u where live) then 'done' else 'not_held' end
    when cmd_type = 7 then case when seq in (select purge from p) then 'done' else 'nothing' end
    when cmd_type = 11 then (select case when exchange_type is null then 'invalid' when was = 11 and exchange_type is distinct from kind then 'conflict' when was = 11 then 'repeated' else 'done' end from z where z.seq = cmd.seq)
    when cmd_type = 12 then (select case when was = 11 then 'done' else 'not_held' end from z where z.seq = cmd.seq)
    when cmd_type between 1 and 15 then 'done' else 'unknown' end as outcome from cmd""")
def command_outcomes(spark, d):
    """What applying each committed command came to, for all fifteen types."""
    log = commands(spark, d).select("seq", "cmd_type", "msg_id", "exchange_name", "exchange_type")
    steps = message_steps(table(spark, d, "raft_commands"))
    hits = steps.where(F.col("begins") | (F.col("live") & F.col("kind").isin(2, 3))).select(F.col("pos").alias("seq")).unionByName(steps.where((F.col("kind") == 0) & F.col("live")).select(F.col("pos").alias("seq")).distinct())
    about = log.where(F.col("cmd_type").isin(1, 2, 3, 7)).join(hits.withColumn("hit", F.lit(True)), "seq", "left")
    hit, type_ = F.coalesce("hit", F.lit(False)), F.col("cmd_type")
    message = (
        F.when(type_ == 7, F.when(hit, "done").otherwise("nothing")).when(F.col("msg_id").isNull(), "invalid")
        .when(type_ == 1, F.when(hit, "inserted").otherwise("repeated")).otherwise(F.when(hit, "done").otherwise("not_held"))
    )
    own = log.where(type_.isin(11, 12) & F.col("exchange_name").isNotNull())
    deletes = {"before": ("max", F.struct("seq", "cmd_type")), "gone": ("max", F.when(type_ == 12, F.col("seq")))}
    eras = running(own, ["exchange_name"], "seq", deletes, inclusive=False).withColumn("era", F.coalesce("gone", F.lit(-1)))
    first = running(eras, ["exchange_name", "era"], "seq", {"first": ("min", F.when(type_ == 11, F.struct("seq", "exchange_type")))}, inclusive=True)
    declared = F.coalesce(F.col("before.cmd_type") == 11, F.lit(False))
    other = ~F.col("exchange_type").eqNullSafe(F.col("first.exchange_type"))
    exchange = F.when(type_ == 12, F.when(declared, "done").otherwise("not_held")).when(F.col("exchange_type").isNull(), "invalid").when(declared & other, "conflict").when(declared, "repeated").otherwise("done")
    rest = log.where(~type_.isin(1, 2, 3, 7) & ~(type_.isin(11, 12) & F.col("exchange_name").isNotNull()) | type_.isNull())
    known = F.when(type_.isin(11, 12), F.lit(None).cast("string")).when(type_.between(1, 15), "done").otherwise("unknown")
    return _each(about, message).unionByName(_each(first, exchange)).unionByName(_each(rest, known))


def _each(log, outcome):
    return log.select("seq", "cmd_type", outcome.alias("outcome"))


@P.add(f"""with {MSG} select topic, cast(sum(n) as bigint) as depth, count(*) filter (where n >= {CAPACITY}) = 10 as is_full
  from (select topic, lvl, count(*) as n from msg group by all) group by topic""")
def queue_is_full(spark, d):
    levels = messages(spark, d).groupBy("topic", "lvl").agg(F.count("*").alias("n"))
    return levels.groupBy("topic").agg(F.sum("n").alias("depth"), (F.count_if(F.col("n") >= CAPACITY) == 10).alias("is_full"))


@P.add(f"with {MSG} select seq, topic, lvl, row_number() over (partition by topic, lvl order by seq) > {CAPACITY} as spilled from msg")
def capacity_spill(spark, d):
    return queueing.spilled(messages(spark, d).select("seq", "topic", "lvl"), CAPACITY)


@P.add(f"""with {MSG} select topic, seq from (select topic, seq, row_number() over (partition by topic order by lvl desc, seq) as rn from msg
  where not (expires_at > 0 and {AS_OF} > expires_at)) where rn = 1""")
def next_message(spark, d):
    return queueing.next_message(messages(spark, d), AS_OF)


#: Messages that a consumer may hold without an answer.
PREFETCH = 2


@P.add(f"""with recursive {EV}, s as (select seq, key, case op when 'view' then 1 else -1 end as step, row_number() over (partition by key order by seq) as n from ev where op in ('view', 'purchase', 'error')),
  w as (select seq, key, n, step, 0 + greatest(0, least({PREFETCH}, step)) as x, step > {PREFETCH} or step < 0 as cut from s where n = 1
    union all select s.seq, s.key, s.n, s.step, greatest(0, least({PREFETCH}, w.x + s.step)), w.x + s.step > {PREFETCH} or w.x + s.step < 0 from w join s on s.key = w.key and s.n = w.n + 1)
  select seq, key, cast(x as bigint) as in_flight, step > 0 and cut as refused from w""")
def prefetch_inflight(spark, d):
    """Unanswered deliveries per consumer: refused beyond the prefetch, and never below 0."""
    log = events(spark, d).where(F.col("op").isin("view", "purchase", "error")).select("seq", "key", F.when(F.col("op") == "view", 1).otherwise(-1).alias("step"))
    walked = walks.bounded(log, "key", "seq", F.col("step"), 0, PREFETCH)
    # what is cut off while the counter is full was a delivery; below 0 it was an answer
    return walked.select("seq", "key", F.col("value").alias("in_flight"), (F.col("cut") & (F.col("value") == PREFETCH)).alias("refused"))


@P.add(f"""with {EV} select seq, key, op, coalesce(was = 'view', false) as accepted from (select seq, key, op, lag(op) over (partition by key order by seq) as was from ev
  where op in ('view', 'purchase', 'error')) where op <> 'view'""")
def answer_outcomes(spark, d):
    """Whether each acknowledgement or rejection met a delivery that was waiting for it; others are errors."""
    log = events(spark, d).where(F.col("op").isin("view", "purchase", "error")).select("seq", "key", "op")
    seen = running(log, ["key"], "seq", {"before": ("max", F.struct("seq", "op"))}, inclusive=False)
    return seen.where(F.col("op") != "view").select("seq", "key", "op", F.coalesce(F.col("before.op") == "view", F.lit(False)).alias("accepted"))


@P.add(f"with {MSG} select seq, topic, (row_number() over (partition by topic order by seq) - 1) % 5 as consumer from msg")
def consumer_assignment(spark, d):
    return queueing.fifo(messages(spark, d).select("seq", "topic")).select("seq", "topic", F.pmod(F.col("pos") - 1, F.lit(5)).alias("consumer"))


@P.add(f"with {EV} select seq, key, row_number() over (partition by key order by seq) as seq_no from ev where op = 'signup'")
def confirm_seq(spark, d):
    return positions(events(spark, d).where(F.col("op") == "signup").select("seq", "key"), ["key"], "seq", "seq_no")


def _ids(log, *kinds):
    return log.where(F.col("cmd_type").isin(*kinds) & F.col("msg_id").isNotNull())


@P.add(f"with {CMD} select distinct msg_id from cmd where cmd_type = 1 and msg_id in (select msg_id from cmd where cmd_type = 2)")
def acked_messages(spark, d):
    log = commands(spark, d)
    return _ids(log, 1).select("msg_id").distinct().join(_ids(log, 2).select("msg_id").distinct(), "msg_id", "left_semi")


@P.add(f"with {CMD} select distinct msg_id from cmd where cmd_type = 1 and msg_id is not null and msg_id not in (select msg_id from cmd where cmd_type = 2 and msg_id is not null)")
def unacked(spark, d):
    log = commands(spark, d)
    return _ids(log, 1).select("msg_id").distinct().join(_ids(log, 2).select("msg_id").distinct(), "msg_id", "left_anti")


@P.add(f"with {CMD} select seq, msg_id, n from (select seq, msg_id, row_number() over (partition by msg_id order by seq) as n from cmd where cmd_type = 2 and msg_id is not null) where n > 1")
def double_acks(spark, d):
    return positions(_ids(commands(spark, d), 2).select("seq", "msg_id"), ["msg_id"], "seq", "n").where(F.col("n") > 1)


@P.add(f"""with {CMD} select msg_id, count(*) as nacks, count(*) > 1 as dead, cast(least(count(*), 1) + 1 as bigint) as deliveries, cast(least(count(*), 2) as bigint) as retry
  from cmd where cmd_type = 3 and msg_id is not null group by 1""")
def retry_dlq(spark, d):
    """Outcome of rejected messages under a limit of one retry."""
    return retries(_ids(commands(spark, d), 3), 1)


def retries(nacks, limit: int):
    """Per message: rejections, whether it's dead, deliveries and retry counter, from their closed form."""
    n = F.count("*")
    return nacks.groupBy("msg_id").agg(
        n.alias("nacks"), (n > limit).alias("dead"), (F.least(n, F.lit(limit)) + 1).cast("long").alias("deliveries"), F.least(n, F.lit(limit + 1)).cast("long").alias("retry")
    )


@P.add(f"""with {EVERY}, {CMD} select distinct msg_id from msg where delivery_count > 0 and msg_id is not null
  and msg_id not in (select msg_id from cmd where cmd_type in (2, 3) and msg_id is not null)""")
def pending_messages(spark, d):
    """Delivered, and neither acknowledged nor rejected."""
    answered = _ids(commands(spark, d), 2, 3).select("msg_id").distinct()
    sent = messages(spark, d, every=True).where((F.col("delivery_count") > 0) & F.col("msg_id").isNotNull()).select("msg_id").distinct()
    return sent.join(answered, "msg_id", "left_anti")


@P.add(f"""with {EVERY}, {CMD} select distinct msg_id from msg where delivery_count > 0 and expires_at > 0 and {AS_OF} > expires_at and msg_id is not null
  and msg_id not in (select msg_id from cmd where cmd_type in (2, 3) and msg_id is not null)""")
def pending_expired(spark, d):
    answered = _ids(commands(spark, d), 2, 3).select("msg_id").distinct()
    late = messages(spark, d, every=True).where((F.col("delivery_count") > 0) & (F.col("expires_at") > 0) & (F.lit(AS_OF) > F.col("expires_at")) & F.col("msg_id").isNotNull())
    return late.select("msg_id").distinct().join(answered, "msg_id", "left_anti")


@P.add(f"""with {EVERY}, {CMD} select m.msg_id, p.seq as promoted_at from (select msg_id, min(seq) as seq from cmd where cmd_type = 6 and msg_id is not null group by 1) p
  join (select distinct msg_id from msg where delay_ns > 0) m on m.msg_id = p.msg_id""")
def promote_by_id(spark, d):
    first = _ids(commands(spark, d), 6).groupBy("msg_id").agg(F.min("seq").alias("promoted_at"))
    return first.join(messages(spark, d, every=True).where(F.col("delay_ns") > 0).select("msg_id").distinct(), "msg_id", "left_semi")


@P.add(f"with {EVERY} select msg_id, min(seq) as seq from msg where msg_id is not null group by 1")
def idempotent_publish(spark, d):
    return messages(spark, d, every=True).where(F.col("msg_id").isNotNull()).groupBy("msg_id").agg(F.min("seq").alias("seq"))


_HELD = f"""held as (select distinct topic, msg_id from msg where msg_id is not null and {_STATE} in ('ready', 'delayed') and msg_id not in (select msg_id from cmd where cmd_type = 2 and msg_id is not null)),
  asked as (select distinct topic, msg_id from cmd where cmd_type in (1, 2, 3, 6) and msg_id is not null)"""


def _held(spark, d):
    """(topic, msg_id) that a queue, a consumer or the delay holds: dead, expired and acknowledged messages aren't held."""
    m = messages(spark, d, every=True).where(F.col("msg_id").isNotNull()).withColumn("state", state_of(AS_OF))
    answered = _ids(commands(spark, d), 2).select("msg_id").distinct()
    return m.where(F.col("state").isin("ready", "delayed")).select("topic", "msg_id").distinct().join(answered, "msg_id", "left_anti")


@P.add(f"with {EVERY}, {CMD}, {_HELD} select distinct msg_id, msg_id in (select msg_id from held) as known from asked")
def has_message(spark, d):
    """Whether the messages that commands name are still held anywhere."""
    known = _held(spark, d).select("msg_id", F.lit(True).alias("known")).distinct()
    asked = _ids(commands(spark, d), 1, 2, 3, 6).select("msg_id").distinct()
    return asked.join(known, "msg_id", "left").select("msg_id", F.coalesce("known", F.lit(False)).alias("known"))


@P.add(f"with {EVERY}, {CMD}, {_HELD} select a.topic, a.msg_id, h.msg_id is not null as known from asked a left join held h on a.topic = h.topic and a.msg_id = h.msg_id where a.topic is not null")
def queue_has_message(spark, d):
    """Whether the messages that commands name are still held by the queue they name."""
    asked = _ids(commands(spark, d), 1, 2, 3, 6).where(F.col("topic").isNotNull()).select("topic", "msg_id").distinct()
    known = _held(spark, d).select("topic", "msg_id", F.lit(True).alias("known"))
    return asked.join(known, ["topic", "msg_id"], "left").select("topic", "msg_id", F.coalesce("known", F.lit(False)).alias("known"))


# Routing. Bindings: (exchange, queue, binding_key, headers, match_all); one queue is bound twice on purpose.
_TOPIC = "orders.topic"
BINDINGS = {
    "topic": [
        (_TOPIC, "q_order", "order.#", None, None), (_TOPIC, "q_vn", "*.*.vn", None, None), (_TOPIC, "q_vn", "*.*.vn.#", None, None),
        (_TOPIC, "q_hi", "#.hi", None, None), (_TOPIC, "q_all", "#", None, None), (_TOPIC, "q_mid", "stock.*.hi", None, None),
        (_TOPIC, "q_created", "#.created.#", None, None), (_TOPIC, "q_exact", "order.created.us", None, None),
    ],
    "direct": [
        ("stock.direct", "q_us", "stock.level.us", None, None), ("stock.direct", "q_vn", "stock.level.vn", None, None),
        ("stock.direct", "q_us", "order.created.us", None, None), ("stock.direct", "q_copy", "stock.level.us", None, None),
    ],
    "fanout": [("all.fanout", q, "", None, None) for q in ("q_a", "q_b", "q_c", "q_a")],
    "headers_all": [
        ("reports.headers", "q_pdf_report", "", {"format": "pdf", "type": "report"}, True), ("reports.headers", "q_no_type", "", {"type": ""}, True),
        ("reports.headers", "q_every", "", {}, True),
    ],
    "headers_any": [("reports.headers", "q_csv_or_api", "", {"format": "csv", "source": "api"}, False), ("reports.headers", "q_none", "", {"format": "xml"}, False)],
}
_SHAPE = "exchange string, queue string, binding_key string, headers map<string,string>, match_all boolean"


def bindings(spark, kind):
    return spark.createDataFrame(BINDINGS[kind], _SHAPE)


def _values(kind):
    return ", ".join(f"('{e}', '{q}', '{k}')" for e, q, k, _, _ in BINDINGS[kind])


_TOPIC_RE = (
    "'^' || array_to_string(list_transform(string_split(binding_key, '.'), lambda s: case s when '#' then '(\\.[^.]*)*' when '*' then '\\.[^.]*' "
    "else '\\.' || regexp_escape(s) end), '') || '$'"
)
_TOPIC_HITS = f"""{MSG}, b(exchange, queue, binding_key) as (values {_values("topic")}), hits as (select distinct seq, msg_id, queue, routing_key from msg join b using (exchange)
  where regexp_matches('.' || routing_key, {_TOPIC_RE}))"""


@P.add(f"with {_TOPIC_HITS} select queue, count(*) as depth from hits group by 1")
def route_topic(spark, d):
    """Depth per queue after wildcard routing."""
    return routing.route(messages(spark, d), bindings(spark, "topic"), "topic").groupBy("queue").agg(F.count("*").alias("depth"))


@P.add(f"with {_TOPIC_HITS} select seq, queue from hits")
def route_topic_rows(spark, d):
    return routing.route(messages(spark, d), bindings(spark, "topic"), "topic").select("seq", "queue")


@P.add(f"with {MSG}, b(exchange, queue, binding_key) as (values {_values('direct')}) select distinct seq, queue from msg join b on msg.exchange = b.exchange and routing_key = binding_key")
def route_direct(spark, d):
    return routing.route(messages(spark, d), bindings(spark, "direct"), "direct").select("seq", "queue")


@P.add(f"with {MSG}, b(exchange, queue, binding_key) as (values {_values('fanout')}) select distinct seq, queue from msg join b using (exchange)")
def route_fanout(spark, d):
    return routing.route(messages(spark, d), bindings(spark, "fanout"), "fanout").select("seq", "queue")


_H = "coalesce(headers['{0}'], '')"


@P.add(f"""with {MSG}, h as (select seq, {_H.format("format")} as f, {_H.format("type")} as t from msg where exchange = 'reports.headers')
  select seq, 'q_pdf_report' as queue from h where f = 'pdf' and t = 'report' union all select seq, 'q_no_type' from h where t = '' union all select seq, 'q_every' from h""")
def route_headers_all(spark, d):
    return routing.route(messages(spark, d), bindings(spark, "headers_all"), "headers").select("seq", "queue")


@P.add(f"""with {MSG} select seq, 'q_csv_or_api' as queue from msg where exchange = 'reports.headers' and ({_H.format("format")} = 'csv' or {_H.format("source")} = 'api')""")
def route_headers_any(spark, d):
    return routing.route(messages(spark, d), bindings(spark, "headers_any"), "headers").select("seq", "queue")


@P.add(f"with {MSG} select seq, routing_key as queue from msg where exchange = '' and routing_key is not null")
def route_default(spark, d):
    return routing.route_default(messages(spark, d)).select("seq", "queue")


@P.add(f"with {MSG}, b(exchange, queue, binding_key) as (values {_values('direct')}) select seq from msg where exchange = 'stock.direct' and coalesce(routing_key, '') not in (select binding_key from b)")
def route_unmatched(spark, d):
    """Messages that no binding of their exchange takes: dropped without an error."""
    sent = messages(spark, d).where(F.col("exchange") == "stock.direct")
    routed = routing.route(sent, bindings(spark, "direct"), "direct")
    return sent.select("seq").join(routed.select("seq"), "seq", "left_anti")


_KNOWN = ("", "orders.topic", "stock.direct")


@P.add(f"with {MSG} select seq, exchange from msg where exchange not in {_KNOWN}")
def route_unknown_exchange(spark, d):
    known = spark.createDataFrame([(x,) for x in _KNOWN], "exchange string")
    return messages(spark, d).select("seq", "exchange").join(known, "exchange", "left_anti")


@P.add(f"with {_TOPIC_HITS} select seq, queue as topic, md5(msg_id || ':' || queue) as clone_id from hits where msg_id is not null")
def route_clones(spark, d):
    routed = routing.route(messages(spark, d).where(F.col("msg_id").isNotNull()), bindings(spark, "topic"), "topic")
    return routing.clones(routed).select("seq", "topic", "clone_id")


@P.add(f"""with {MSG} select topic as name, count(*) filter (where retry <= max_retry) as depth, count(*) filter (where retry > max_retry) as dead from msg group by 1""")
def queue_dlq_overview(spark, d):
    """Each queue beside its dead-letter queue, 0 where there is none."""
    m = messages(spark, d)
    depth = m.groupBy(F.col("topic").alias("name")).agg(F.count_if(~is_dead(F.col("retry"), F.col("max_retry"))).alias("depth"))
    dead = m.where(is_dead(F.col("retry"), F.col("max_retry"))).groupBy(F.col("topic").alias("name")).agg(F.count("*").alias("dead"))
    return depth.join(dead, "name", "left").select("name", "depth", F.coalesce("dead", F.lit(0)).alias("dead"))


_SUBS = """subs as (select topic, subscriber_id, seq as from_seq from (select topic, subscriber_id, seq, cmd_type, row_number() over (partition by topic, subscriber_id order by seq desc) as rn
  from cmd where cmd_type in (9, 10) and topic is not null and subscriber_id is not null) where rn = 1 and cmd_type = 9)"""


def subscriptions(log):
    """(topic, subscriber_id, from_seq): what is subscribed at the end; the latest command of each counts."""
    own = log.where(F.col("cmd_type").isin(9, 10) & F.col("topic").isNotNull() & F.col("subscriber_id").isNotNull())
    last = own.groupBy("topic", "subscriber_id").agg(F.max(F.struct("seq", "cmd_type")).alias("c"))
    return last.where(F.col("c.cmd_type") == 9).select("topic", "subscriber_id", F.col("c.seq").alias("from_seq"))


@P.add(f"with {CMD}, {_SUBS} select topic, subscriber_id, from_seq from subs")
def active_subscribers(spark, d):
    return subscriptions(commands(spark, d))


@P.add(f"with {CMD}, {_SUBS} select c.seq, s.subscriber_id from cmd c join subs s on c.topic = s.topic where c.cmd_type = 4")
def pubsub_fanout(spark, d):
    log = commands(spark, d)
    return join_salted(log.where((F.col("cmd_type") == 4) & F.col("topic").isNotNull()).select("seq", "topic"), subscriptions(log), "topic", "seq").select("seq", "subscriber_id")


#: What is published: to subscribers (4) and, for the topics' load in these tables, to queues (1).
_SENT = (1, 4)


@P.add(f"with {CMD}, {_SUBS} select topic, subscriber_id, topic || ':' || subscriber_id as queue from subs")
def durable_queue_name(spark, d):
    return subscriptions(commands(spark, d)).select("topic", "subscriber_id", S.durable_queue(F.col("topic"), F.col("subscriber_id")).alias("queue"))


def _sent_before(log, marks):
    """marks (topic, subscriber_id, seq) with `sent`: messages published to the topic before each, from one pass along the topic."""
    sent = log.where(F.col("cmd_type").isin(*_SENT)).select("topic", "seq", F.lit(None).cast("string").alias("subscriber_id"))
    both = sent.unionByName(marks.select("topic", "seq", "subscriber_id"))
    n = F.when(F.col("subscriber_id").isNull(), 1).otherwise(0).cast("long")
    return running(both, ["topic"], "seq", {"sent": ("sum", n)}, inclusive=False).where(F.col("subscriber_id").isNotNull()).withColumn("sent", F.coalesce("sent", F.lit(0)))


@P.add(f"""with {CMD}, k as (select topic, subscriber_id, seq, cmd_type, lag(seq) over w as since, lag(cmd_type) over w as was from cmd where cmd_type in (9, 10) and topic is not null and subscriber_id is not null
    window w as (partition by topic, subscriber_id order by seq))
  select topic, subscriber_id, seq, case when was = 9 then (select count(*) from cmd c where c.topic = k.topic and c.cmd_type in {_SENT} and c.seq > since and c.seq < k.seq) else 0 end as delivered from k where cmd_type = 9""")
def durable_deliveries(spark, d):
    """What a durable subscriber gets when it connects again: all that was published since its last delivery."""
    log = commands(spark, d).where(F.col("topic").isNotNull())
    marks = log.where(F.col("cmd_type").isin(9, 10) & F.col("subscriber_id").isNotNull())
    kinds = marks.select("seq", F.col("cmd_type").alias("kind"))
    counted = _sent_before(log, marks).join(kinds, "seq")
    last = {"before": ("max", F.struct("seq", F.col("kind").alias("was"), F.col("sent").alias("had")))}
    seen = running(counted, ["topic", "subscriber_id"], "seq", last, inclusive=False).where(F.col("kind") == 9)
    fresh = F.when(F.col("before.was") == 9, F.col("sent") - F.col("before.had")).otherwise(F.lit(0))
    return seen.select("topic", "subscriber_id", "seq", fresh.alias("delivered"))


@P.add(f"""with {CMD}, {_SUBS} select s.topic, s.subscriber_id, count(c.seq) as waiting from subs s
  left join cmd c on c.topic = s.topic and c.cmd_type in {_SENT} and c.seq > s.from_seq group by 1, 2""")
def durable_catchup(spark, d):
    """Messages that wait for each durable subscriber at the end: published since it last connected and got what there was."""
    log = commands(spark, d).where(F.col("topic").isNotNull())
    before = _sent_before(log, subscriptions(log).withColumnRenamed("from_seq", "seq"))
    total = log.where(F.col("cmd_type").isin(*_SENT)).groupBy("topic").agg(F.count("*").alias("total"))
    return before.join(total, "topic", "left").select("topic", "subscriber_id", (F.coalesce("total", F.lit(0)) - F.col("sent")).alias("waiting"))


#: Messages that a subscriber's channel holds until it reads again, once an hour here.
BUFFER = 1


@P.add(f"""with {CMD}, k as (select topic, subscriber_id, seq, cmd_type, lead(seq) over (partition by topic, subscriber_id order by seq) as until from cmd
    where cmd_type in (9, 10) and topic is not null and subscriber_id is not null),
  n as (select c.topic, k.subscriber_id, date_trunc('hour', applied_at at time zone 'UTC') as hour, count(*) as n from cmd c join k on c.topic = k.topic and c.seq > k.seq and c.seq < coalesce(k.until, 9223372036854775807)
    where c.cmd_type in {_SENT} and k.cmd_type = 9 and applied_at is not null group by all)
  select topic, subscriber_id, hour, least(n, {BUFFER}) as delivered, n - {BUFFER} as dropped from n where n > {BUFFER}""")
def subscriber_drops(spark, d):
    """What each slow subscriber misses: of the messages published while it was subscribed, those beyond its buffer in an hour."""
    log = commands(spark, d).where(F.col("topic").isNotNull())
    marks = log.where(F.col("cmd_type").isin(9, 10) & F.col("subscriber_id").isNotNull()).select("topic", "subscriber_id", "seq", "cmd_type")
    ends = running(marks.withColumn("back", -F.col("seq")), ["topic", "subscriber_id"], "back", {"next": ("max", F.col("back"))}, inclusive=False)
    spans = ends.where(F.col("cmd_type") == 9).select("topic", "subscriber_id", F.col("seq").alias("since"), F.coalesce(-F.col("next"), F.lit(9223372036854775807)).alias("until"))
    hour = F.date_trunc("hour", "applied_at").cast("timestamp_ntz").alias("hour")
    sent = log.where(F.col("cmd_type").isin(*_SENT) & F.col("applied_at").isNotNull()).select("topic", "seq", hour)
    # of the subscribers of a busy topic each message meets those in a salted part: no topic is one task's work
    per = join_salted(sent, spans, "topic", "seq").where(F.col("seq").between(F.col("since") + 1, F.col("until") - 1)).groupBy("topic", "subscriber_id", "hour").agg(F.count("*").alias("n"))
    return per.where(F.col("n") > BUFFER).select("topic", "subscriber_id", "hour", F.least("n", F.lit(BUFFER)).cast("long").alias("delivered"), (F.col("n") - BUFFER).alias("dropped"))


@P.add(f"""with {WAL} select distinct node_id, msg_id from wal w where rec_type = 1 and msg_id is not null
  and not exists (select 1 from wal a where a.rec_type = 2 and a.node_id = w.node_id and a.msg_id = w.msg_id)""")
def wal_active(spark, d):
    """Published and never acknowledged on the same node."""
    log = wal(spark, d).where(F.col("msg_id").isNotNull())
    ids = lambda k: log.where(F.col("rec_type") == k).select("node_id", "msg_id").distinct()
    return ids(1).join(ids(2), ["node_id", "msg_id"], "left_anti")


_LIVE = """live as (select node_id, msg_id, lsn, topic, priority from (select *, row_number() over (partition by node_id, msg_id order by lsn desc) as rn
  from wal where rec_type in (1, 2) and msg_id is not null) where rn = 1 and rec_type = 1)"""


@P.add(f"with {WAL}, {_LIVE} select * from live")
def wal_recover(spark, d):
    """What a log recovers to: the last publish of every message not acknowledged after it."""
    log = wal(spark, d).where(F.col("rec_type").isin(1, 2) & F.col("msg_id").isNotNull())
    last = log.groupBy("node_id", "msg_id").agg(F.max_by(F.struct("rec_type", "lsn", "topic", "priority"), "lsn").alias("c"))
    return last.where(F.col("c.rec_type") == 1).select("node_id", "msg_id", "c.lsn", "c.topic", "c.priority")


@P.add(f"with {WAL}, {_LIVE} select node_id, count(*) as records, cast(sum(octet_length(encode(coalesce(payload, ''))) + 9) as bigint) as bytes from live join wal using (node_id, lsn, msg_id) group by 1")
def wal_compact(spark, d):
    """Records and bytes per node that a compacted log keeps."""
    kept = wal_live(table(spark, d, "wal_records")).select(F.col("feed").alias("node_id"), "msg_id", F.col("pos").alias("lsn"))
    size = (F.octet_length(F.coalesce("payload", F.lit(""))) + 9).cast("long")
    return wal(spark, d).join(kept, ["node_id", "lsn", "msg_id"]).groupBy("node_id").agg(F.count("*").alias("records"), F.sum(size).alias("bytes"))


@P.add(f"with {WAL}, {_LIVE} select live.node_id, live.msg_id, live.topic, live.priority, payload from live join wal using (node_id, lsn, msg_id)")
def wal_rewrite(spark, d):
    """The compacted log itself: what is live, written as binary segments and read again."""
    ship(spark)
    wal_source.register(spark)
    kept = wal_live(table(spark, d, "wal_records")).select(F.col("feed").alias("node_id"), "msg_id", F.col("pos").alias("lsn"))
    body = F.to_json(F.struct("node_id", "msg_id", "topic", "priority", "payload"))
    path = fresh_dir(spark, "compacted")
    wal(spark, d).join(kept, ["node_id", "lsn", "msg_id"]).select(F.lit(1).alias("rec_type"), F.encode(body, "UTF-8").alias("data")).write.format("wal").mode("overwrite").save(path)
    back = F.from_json(F.decode("data", "UTF-8"), "node_id string, msg_id string, topic string, priority int, payload string").alias("m")
    return spark.read.format("wal").load(path).where(F.col("rec_type") == 1).select(back).select("m.*")


@P.add(f"""with {WAL} select msg_id from wal where node_id = 'node-a' and rec_type = 2 and msg_id is not null intersect select msg_id from wal where node_id = 'node-b' and rec_type = 2""")
def replica_intersect(spark, d):
    """Messages acknowledged on both of two nodes."""
    log = wal(spark, d).where((F.col("rec_type") == 2) & F.col("msg_id").isNotNull())
    on = lambda n: log.where(F.col("node_id") == n).select("msg_id")
    return on("node-a").intersect(on("node-b"))


@P.add(f"""with {WAL}, {_LIVE}, a as (select msg_id from live where node_id = 'node-a'), b as (select msg_id from live where node_id = 'node-b')
  select msg_id, 'a' as only_on from (select msg_id from a except select msg_id from b) union all select msg_id, 'b' from (select msg_id from b except select msg_id from a)""")
def replica_diff(spark, d):
    live = wal_live(table(spark, d, "wal_records"))
    on = lambda n: live.where(F.col("feed") == n).select("msg_id")
    a, b = on("node-a"), on("node-b")
    return a.subtract(b).withColumn("only_on", F.lit("a")).unionByName(b.subtract(a).withColumn("only_on", F.lit("b")))


@P.add(f"with {EVERY} select distinct msg_id from msg where msg_id is not null and {_STATE} in ('ready', 'dead', 'delayed')")
def active_union(spark, d):
    """Every message that some holder (queues, dead letters, delayed) still has."""
    m = messages(spark, d, every=True).where(F.col("msg_id").isNotNull()).withColumn("state", state_of(AS_OF))
    held = [m.where(F.col("state") == s).select("msg_id") for s in ("ready", "dead", "delayed")]
    return held[0].unionByName(held[1]).unionByName(held[2]).distinct()


@P.add(f"with {MSG} select {_STATE} as bucket, topic, seq, msg_id, priority, retry from msg where {_STATE} <> 'future'")
def snapshot_full_state(spark, d):
    """Every bucket's messages in one table."""
    return messages(spark, d).select(state_of(AS_OF).alias("bucket"), "topic", "seq", "msg_id", "priority", "retry").where(F.col("bucket") != "future")
