"""Queries of the key-value store, of statistics and of log replay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallylog.functions import scalars as S
from tallylog.functions.scalars import clamp_priority, glob_match, is_dead, wal_record_bytes
from tallylog.operators import kv, stats
from tallylog.operators.changes import WAL_ACK, WAL_PUBLISH, apply_changes, raft_state
from tallylog.operators.ranges import positions, running
from tallylog.plans.base import AS_OF, AS_OF_EVENTS, CMD, EV, LIVES, MSG, WAL, Plans, commands, events, messages, wal
from tallylog.plans.queues import _SUBS, subscriptions
from tallylog.plans.scalars import _STATE, state_of
from tallylog.session import fresh_dir
from tallylog.sources.snapshots import read_snapshot, write_snapshot
from tallylog.sources.tables import table

P = Plans()

_HOUR = 3_600_000_000_000
#: expire gives a key ten days.
_EXPIRE = 240 * _HOUR

_KV = f"""ops as (select * from ev where ts_ns <= {AS_OF_EVENTS}),
w as (select * from (select key, op, seq, k, ts_ns, ttl_ns, row_number() over (partition by key order by seq desc) as rn from ops where op in ('signup', 'purchase')) where rn = 1),
e as (select key, max(seq) as eseq, max(ts_ns) as ets from ops where op = 'error' group by 1),
entries as (select w.key, k as value, ts_ns as created_ns, case when eseq > seq then ets + {_EXPIRE} when ttl_ns > 0 then ts_ns + ttl_ns else 0 end as expires_ns
  from w left join e on w.key = e.key where op = 'signup'),
live as (select * from entries where expires_ns = 0 or {AS_OF_EVENTS} <= expires_ns)"""


def _ops(spark, d):
    return events(spark, d).where(F.col("ts_ns") <= AS_OF_EVENTS)


def _entries(spark, d):
    return kv.entries(_ops(spark, d), _EXPIRE)


def _live(spark, d):
    return _entries(spark, d).where(kv.alive(AS_OF_EVENTS))


@P.add(f"with {EV}, {_KV} select key, k as value from w where op = 'signup'")
def kv_lww(spark, d):
    last = kv.last_writes(_ops(spark, d))
    return last.where(F.col("op") == kv.SET).select("key", F.col("k").alias("value"))


@P.add(f"with {EV}, {_KV} select key, value, created_ns, expires_ns from live")
def kv_live(spark, d):
    return _live(spark, d)


@P.add(f"with {EV}, {_KV} select key, value, created_ns, expires_ns from live")
def kv_snapshot(spark, d):
    """What is live, written as a snapshot and restored from it."""
    path = fresh_dir(spark, "kv-snapshot")
    write_snapshot(_live(spark, d).withColumn("bucket", F.lit("kv")), path)
    return read_snapshot(spark, path).select("key", "value", "created_ns", "expires_ns")


@P.add(f"""with {EV} select seq, key, value from (select seq, key, op, last_value(case when op in ('signup', 'purchase') then seq end ignore nulls) over (partition by key order by seq rows unbounded preceding) as s from ev) x
  left join (select seq as wseq, case when op = 'signup' then k end as value from ev) y on x.s = y.wseq where op = 'view'""")
def kv_get_asof(spark, d):
    return kv.gets(events(spark, d))


@P.add(f"""with {EV} select seq, key, coalesce(prev = 'signup', false) as existed from (select seq, key, op,
  lag(op) over (partition by key order by seq) as prev from ev where op in ('signup', 'purchase')) where op = 'purchase'""")
def kv_delete(spark, d):
    """Whether each delete found its key."""
    ops = events(spark, d).where(F.col("op").isin(kv.SET, kv.DEL)).select("seq", "key", "op")
    seen = running(ops, ["key"], "seq", {"before": ("max", F.struct("seq", "op"))}, inclusive=False)
    return seen.where(F.col("op") == kv.DEL).select("seq", "key", F.coalesce(F.col("before.op") == kv.SET, F.lit(False)).alias("existed"))


@P.add(f"with {EV}, {_KV} select distinct ev.key, live.key is not null as found from ev left join live on ev.key = live.key")
def kv_exists(spark, d):
    asked = events(spark, d).select("key").distinct()
    return asked.join(_live(spark, d).select("key", F.lit(True).alias("found")), "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found"))


_NAME = "'user:' || key"
_GLOBS = ("user:1*", "*9", "*:2*", "user:3", "*", "u*r:4")


@P.add(f"""with {EV}, {_KV}, n as (select {_NAME} as name from live)
  select p as pattern, name from n, (values {", ".join(f"('{g}')" for g in _GLOBS)}) t(p) where case when p in ('', '*') then true
  when length(p) > 1 and p[1] = '*' and p[-1] = '*' then contains(name, p[2:-2]) when p[-1] = '*' then starts_with(name, p[1:-2]) when p[1] = '*' then suffix(name, p[2:]) else name = p end""")
def kv_keys_glob(spark, d):
    name = F.concat(F.lit("user:"), F.col("key").cast("string"))
    named = _live(spark, d).select(name.alias("name"))
    hits = F.array(*[F.when(glob_match(g, F.col("name")), F.lit(g)) for g in _GLOBS])
    return named.select(F.explode(F.array_compact(hits)).alias("pattern"), "name")


@P.add(f"with {EV}, {_KV} select {_NAME} as name from live where contains(lower({_NAME}), lower('R:1'))")
def kv_search(spark, d):
    name = F.concat(F.lit("user:"), F.col("key").cast("string"))
    return _live(spark, d).select(name.alias("name")).where(F.contains(F.lower("name"), F.lower(F.lit("R:1"))))


@P.add(f"with {EV}, {_KV} select e.key, ets + {_EXPIRE} as expires_ns from e join w on e.key = w.key where op = 'signup' and eseq > seq")
def kv_expire(spark, d):
    """Keys whose expiry an expire command set after the last write."""
    ops = _ops(spark, d)
    last = kv.last_writes(ops).where(F.col("op") == kv.SET).select("key", "seq")
    e = ops.where(F.col("op") == kv.EXPIRE).groupBy("key").agg(F.max(F.struct("seq", "ts_ns")).alias("e"))
    return last.join(e, "key").where(F.col("e.seq") > F.col("seq")).select("key", (F.col("e.ts_ns") + _EXPIRE).alias("expires_ns"))


@P.add(f"""with {EV} select seq, key, cast(sum(case op when 'signup' then k when 'click' then k else 0 end) over (partition by key, seg order by seq) as bigint) as value, op from
  (select *, count(*) filter (where op in ('signup', 'purchase')) over (partition by key order by seq) as seg from ev where op in ('signup', 'purchase', 'click')) qualify op = 'click'""")
def kv_incr(spark, d):
    return kv.increments(events(spark, d)).withColumn("op", F.lit(kv.INCR))


@P.add(f"with {EV}, f as (select max(seq) as at from ev where k = 0) select count(distinct key) as flushed from ev, f where op = 'signup' and seq < f.at")
def kv_flush(spark, d):
    """Keys ever set before the last flush."""
    log = events(spark, d)
    at = log.where(F.col("k") == 0).agg(F.max("seq")).first()[0]
    return log.where((F.col("op") == kv.SET) & (F.col("seq") < F.lit(at))).agg(F.countDistinct("key").alias("flushed"))


@P.add(f"with {EV}, {_KV} select count(*) as expired from entries where expires_ns <> 0 and {AS_OF_EVENTS} > expires_ns")
def kv_expired_count(spark, d):
    return _entries(spark, d).where(~kv.alive(AS_OF_EVENTS)).agg(F.count("*").alias("expired"))


@P.add(f"with {EV}, {_KV} select key, created_ns from (select *, row_number() over (order by created_ns desc, key) as rn from live) where rn > 20")
def kv_evict(spark, d):
    return kv.evicted(_live(spark, d), 20).select("key", "created_ns")


@P.add(f"with {EV}, {_KV} select {_NAME} as name, value, (select count(*) from live) as total from live order by 1 limit 100")
def kv_entries_page(spark, d):
    name = F.concat(F.lit("user:"), F.col("key").cast("string"))
    live = _live(spark, d).select(name.alias("name"), "value")
    return live.orderBy("name").limit(100).withColumn("total", F.lit(live.count()).cast("long"))


@P.add(f"""with {EV}, {_KV} select (select count(*) from live) as key_count, (select cast(sum(octet_length(encode({_NAME})) + length(cast(value as varchar))) as bigint) from live) as memory_used,
  count(*) filter (where op = 'view') as gets, count(*) filter (where op = 'signup') as sets, count(*) filter (where op = 'purchase') as deletes from ops""")
def kv_stats(spark, d):
    name = F.concat(F.lit("user:"), F.col("key").cast("string"))
    held = _live(spark, d).agg(F.count("*").alias("key_count"), F.sum(F.octet_length(name) + F.octet_length(F.col("value").cast("string"))).alias("memory_used"))
    done = _ops(spark, d).agg(F.count_if(F.col("op") == kv.GET).alias("gets"), F.count_if(F.col("op") == kv.SET).alias("sets"), F.count_if(F.col("op") == kv.DEL).alias("deletes"))
    return held.withColumn("j", F.lit(1)).join(done.withColumn("j", F.lit(1)), "j").drop("j")


@P.add(f"""with {EV}, g as (select seq, key, op, last_value(case when op in ('signup', 'purchase') then op end ignore nulls) over (partition by key order by seq rows unbounded preceding) as s from ev)
  select count(*) filter (where s = 'signup') as hits, count(*) filter (where s is distinct from 'signup') as misses,
  cast(1000 * count(*) filter (where s = 'signup') // count(*) as bigint) as permille from g where op = 'view'""")
def kv_hit_rate(spark, d):
    found = kv.gets(events(spark, d)).agg(F.count("value").alias("hits"), F.count_if(F.col("value").isNull()).alias("misses"))
    return found.withColumn("permille", F.floor(F.try_divide(F.col("hits") * 1000, F.col("hits") + F.col("misses"))).cast("long"))


# Statistics


_QUEUES = """known as (select topic as name from msg union select topic from cmd where cmd_type in (1, 5) and topic is not null union select queue_name from cmd where cmd_type = 13 and queue_name is not null)"""


def _queues(spark, d):
    """Every queue that a publish, a consume or a binding made: each is there from then on, empty or not."""
    log = commands(spark, d)
    made = log.where(F.col("cmd_type").isin(1, 5)).select(F.col("topic").alias("name")).unionByName(log.where(F.col("cmd_type") == 13).select(F.col("queue_name").alias("name")))
    return messages(spark, d).select(F.col("topic").alias("name")).unionByName(made.where(F.col("name").isNotNull())).distinct()


@P.add(f"with {MSG}, {CMD}, {_QUEUES} select name, count(seq) as depth from known left join msg on topic = name and {_STATE} = 'ready' group by 1")
def queue_depths(spark, d):
    """Depth of every queue there is; drained and never used ones show 0."""
    ready = messages(spark, d).where(state_of(AS_OF) == "ready").groupBy(F.col("topic").alias("name")).agg(F.count("*").alias("depth"))
    return _queues(spark, d).join(ready, "name", "left").select("name", F.coalesce("depth", F.lit(0)).alias("depth"))


@P.add(f"""with {MSG}, {CMD}, {_SUBS}, {_QUEUES} select 'queue' as kind, name, count(seq) as n from known left join msg on topic = name and {_STATE} = 'ready' group by 2
  union all select 'dead_letter', topic || '_dead_letter', count(*) from msg where {_STATE} = 'dead' group by 2
  union all select 'topic', t.topic, count(subscriber_id) from (select distinct topic from cmd where cmd_type in (4, 9) and topic is not null) t left join subs on subs.topic = t.topic group by 2
  union all select 'total', 'delayed', count(*) from msg where {_STATE} = 'delayed'
  union all select 'total', 'pending', count(*) from msg where {_STATE} = 'ready' and delivery_count > 0""")
def broker_stats(spark, d):
    m = messages(spark, d).withColumn("state", state_of(AS_OF))
    per = lambda df, name: df.groupBy(name.alias("name")).agg(F.count("*").alias("n"))
    one = lambda df, name: df.agg(F.count("*").alias("n")).withColumn("name", F.lit(name))
    ready, log = m.where(F.col("state") == "ready"), commands(spark, d)
    topics = log.where(F.col("cmd_type").isin(4, 9) & F.col("topic").isNotNull()).select(F.col("topic").alias("name")).distinct()
    return stats.long_format([
        ("queue", queue_depths(spark, d).withColumnRenamed("depth", "n")),
        ("dead_letter", per(m.where(F.col("state") == "dead"), F.concat("topic", F.lit("_dead_letter")))),
        ("topic", topics.join(per(subscriptions(log), F.col("topic")), "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))),
        ("total", one(m.where(F.col("state") == "delayed"), "delayed")),
        ("total", one(ready.where(F.col("delivery_count") > 0), "pending")),
    ])


#: The counters by name, with what feeds them: command types, or store operations.
_COUNTERS = {
    "messages_published": "cmd_type in (1, 4, 15)", "messages_consumed": "cmd_type = 5", "messages_acked": "cmd_type = 2", "messages_nacked": "cmd_type = 3",
    "raft_apply_count": "cmd_type between 1 and 15",
}
_CACHE = {"cache_sets": "op = 'signup'", "cache_deletes": "op = 'purchase'"}
#: The limit of rejections for retry_count and dead_letter_count, as in retry_dlq.
_LIMIT = 1
_COUNT_SQL = " union all ".join(
    [f"select '{n}' as name, count(*) filter (where {c}) as value from cmd" for n, c in _COUNTERS.items()]
    + [f"select '{n}', count(*) filter (where {c}) from ev" for n, c in _CACHE.items()]
    + [
        f"select 'retry_count', cast(coalesce(sum(least(n, {_LIMIT})), 0) as bigint) from nacked", f"select 'dead_letter_count', count(*) filter (where n > {_LIMIT}) from nacked",
        "select 'cache_hits', count(*) filter (where s = 'signup') from got", "select 'cache_misses', count(*) filter (where s is distinct from 'signup') from got",
        "select 'leader_changes', greatest(count(distinct term) - 1, 0) from raft_commands r join cmd on cmd.cmd_row = r.cmd_row", "select 'snapshot_count', 0",
    ]
)
_COUNTED = f"""{CMD.replace("select log_index as seq", "select cmd_row, log_index as seq")}, {EV}, nacked as (select msg_id, count(*) as n from cmd where cmd_type = 3 and msg_id is not null group by 1),
  got as (select s from (select op, last_value(case when op in ('signup', 'purchase') then op end ignore nulls) over (partition by key order by seq rows unbounded preceding) as s from ev) where op = 'view')"""


@P.add(f"with {_COUNTED} {_COUNT_SQL}")
def metrics_counters(spark, d):
    """The thirteen counters from the logs. A term's first committed entry is a change of leader; these logs hold no
    command for a snapshot, so its count is 0."""
    log, ev = commands(spark, d), events(spark, d)
    nacks = log.where((F.col("cmd_type") == 3) & F.col("msg_id").isNotNull()).groupBy("msg_id").agg(F.count("*").alias("n"))
    retried = nacks.agg(F.coalesce(F.sum(F.least("n", F.lit(_LIMIT))), F.lit(0)).alias("retry_count"), F.count_if(F.col("n") > _LIMIT).alias("dead_letter_count"))
    got = kv.gets(ev).agg(F.count("value").alias("cache_hits"), F.count_if(F.col("value").isNull()).alias("cache_misses"))
    terms = table(spark, d, "raft_commands").where(F.col("log_index").isNotNull()).groupBy("log_index").agg(F.max("term").alias("term"))
    leaders = terms.agg(F.greatest(F.countDistinct("term") - 1, F.lit(0)).alias("leader_changes")).withColumn("snapshot_count", F.lit(0).cast("long"))
    parts = [stats.counters(log, {n: F.expr(c) for n, c in _COUNTERS.items()}), stats.counters(ev, {n: F.expr(c) for n, c in _CACHE.items()}), *map(stats.named, (retried, got, leaders))]
    return reduce(DataFrame.unionByName, parts)


_NAMES = (
    "messages_published", "messages_consumed", "messages_acked", "messages_nacked", "retry_count", "dead_letter_count", "raft_apply_count", "snapshot_count", "leader_changes",
    "cache_hits", "cache_misses", "cache_sets", "cache_deletes",
)


@P.add(f"""with {_COUNTED}, c as ({_COUNT_SQL}) select '{{' || string_agg('"' || name || '":' || value, ',' order by list_position({list(_NAMES)}, name)) || '}}' as line from c""")
def metrics_json(spark, d):
    """The counters as one JSON object."""
    c = metrics_counters(spark, d)
    row = c.agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in _NAMES])
    return row.select(F.to_json(F.struct(*_NAMES)).alias("line"))


@P.add(f"""with {_COUNTED}, c as ({_COUNT_SQL}) select '# HELP ' || name || ' Total ' || replace(name, '_', ' ') as line from c
  union all select '# TYPE ' || name || ' counter' from c union all select name || ' ' || value from c""")
def prometheus_lines(spark, d):
    c, name = metrics_counters(spark, d), F.col("name")
    lines = F.array(
        F.concat(F.lit("# HELP "), name, F.lit(" Total "), F.replace(name, F.lit("_"), F.lit(" "))), F.concat(F.lit("# TYPE "), name, F.lit(" counter")),
        F.concat_ws(" ", name, F.col("value").cast("string")),
    )
    return c.select(F.explode(lines).alias("line"))


@P.add(f"""with {_COUNTED}, {MSG}, {WAL}, c as ({_COUNT_SQL}) select 'metric' as kind, name, cast(value as bigint) as n from c
  union all select 'storage', 'wal_bytes', cast(sum(octet_length(encode(coalesce(payload, msg_id, ''))) + 9) as bigint) from wal
  union all select 'state', {_STATE}, count(*) from msg group by 2""")
def overview(spark, d):
    """Metrics, storage and message states in one table."""
    size = wal(spark, d).agg(F.sum(wal_record_bytes(F.coalesce("payload", "msg_id", F.lit("")))).alias("n")).withColumn("name", F.lit("wal_bytes"))
    states = messages(spark, d).groupBy(state_of(AS_OF).alias("name")).agg(F.count("*").alias("n"))
    return stats.long_format([("metric", metrics_counters(spark, d).withColumnRenamed("value", "n")), ("storage", size), ("state", states)])


@P.add(f"with {MSG} select count(distinct topic) as queues, count(*) as messages from msg where retry > max_retry")
def dlq_total(spark, d):
    dead = messages(spark, d).where(is_dead(F.col("retry"), F.col("max_retry")))
    return dead.agg(F.countDistinct("topic").alias("queues"), F.count("*").alias("messages"))


@P.add(f"""with {WAL}, s as (select node_id, lsn, cast(sum(octet_length(encode(coalesce(payload, msg_id, ''))) + 9) over (partition by node_id order by lsn) as bigint) as total from wal)
  select node_id, min(lsn) as lsn from s where total > 10000 group by 1""")
def compaction_trigger(spark, d):
    """Where each node's log first exceeds 10,000 bytes."""
    sized = wal(spark, d).select("node_id", "lsn", wal_record_bytes(F.coalesce("payload", "msg_id", F.lit(""))).alias("bytes"))
    summed = running(sized, ["node_id"], "lsn", {"total": ("sum", F.col("bytes"))}, inclusive=True)
    return summed.where(F.col("total") > 10000).groupBy("node_id").agg(F.min("lsn").alias("lsn"))


_RATES = """count(*) filter (where op = 'signup') as published, count(*) filter (where op = 'view') as consumed, count(*) filter (where op = 'purchase') as acked"""


def _rates():
    return {"published": F.col("op") == "signup", "consumed": F.col("op") == "view", "acked": F.col("op") == "purchase"}


@P.add(f"with {EV} select time_bucket(interval 5 minute, ts) as start, {_RATES} from ev group by 1")
def rate_5m(spark, d):
    by = events(spark, d).groupBy(F.window("ts", "5 minutes")["start"].alias("start"))
    return by.agg(*[F.count_if(c).alias(n) for n, c in _rates().items()])


@P.add(f"with {EV}, r as (select date_trunc('day', ts) as day, {_RATES} from ev group by 1) select cast(day as timestamp) as day, acked, consumed, cast(1000 * acked // consumed as bigint) as permille from r where consumed > 0")
def success_rate(spark, d):
    by = events(spark, d).groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(*[F.count_if(c).alias(n) for n, c in _rates().items()])
    return by.where(F.col("consumed") > 0).select("day", "acked", "consumed", F.floor(F.col("acked") * 1000 / F.col("consumed")).cast("long").alias("permille"))


_H = f"h as (select cast(date_trunc('hour', ts) as timestamp) as hour, {_RATES}, count(*) filter (where op = 'error') as errors from ev group by 1)"
_STREAK = """select min(hour) as start, max(hour) as "end", count(*) as n from (select hour, row_number() over (order by hour) - rn as island from
  (select hour, row_number() over (order by hour) as rn, {0} as over_ from h) where over_) group by island having count(*) >= 2"""


def _hours(spark, d):
    return stats.hourly(events(spark, d), "ts", _rates() | {"errors": F.col("op") == "error"})


@P.add(f"with {EV}, {_H} " + _STREAK.format("errors > 1"))
def alert_errors_hourly(spark, d):
    """The alerts' shape at this log's own pace: hours with more than one error, two or more in a row."""
    return stats.streaks(_hours(spark, d), "hour", F.col("errors") > 1, 2)


@P.add(f"with {EV}, {_H} " + _STREAK.format("published - consumed > 1"))
def alert_lag_hourly(spark, d):
    return stats.streaks(_hours(spark, d), "hour", F.col("published") - F.col("consumed") > 1, 2)


#: Fixed values of the documented alerts: dead letters a second for five minutes, lag a second for ten.
_DLQ_RATE, _LAG_RATE, _WINDOW_S = 1, 100, 300
_R5 = f"""e as (select ts, op, case when op = 'error' then row_number() over (partition by key, op order by seq) end as nth from ev),
  r as (select time_bucket(interval 5 minute, ts) as start, {_RATES}, count(*) filter (where nth <= 5) as retried, count(*) filter (where nth > 5) as dead from e group by 1)"""
_HELD_FOR = """select min(start) as start, max(start) as "end", count(*) as n from (select start, epoch(start) // 300 - row_number() over (order by start) as island from r where {0}) group by island having count(*) >= {1}"""


def _five_minutes(spark, d):
    """(start, published, consumed, acked, retried, dead) per five minutes; a key's errors beyond the retry limit are dead letters."""
    log = events(spark, d)
    errors = positions(log.where(F.col("op") == "error").select("seq", "key", "ts"), ["key"], "seq", "nth").select("ts", F.lit("error").alias("op"), "nth")
    both = log.where(F.col("op") != "error").select("ts", "op", F.lit(None).cast("long").alias("nth")).unionByName(errors)
    counts = _rates() | {"retried": F.col("nth") <= S.DEFAULT_MAX_RETRY, "dead": F.col("nth") > S.DEFAULT_MAX_RETRY}
    return both.groupBy(F.window("ts", "5 minutes")["start"].alias("start")).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


@P.add(f"with {EV}, {_R5} select start, retried / 300.0::double as retry_rate, dead / 300.0::double as dead_letter_rate, case when consumed > 0 then acked * 100.0::double / consumed end as success_pct from r")
def delivery_rates_5m(spark, d):
    """Retries and dead letters a second, and the share of deliveries acknowledged."""
    rate = lambda c: F.col(c).cast("double") / F.lit(float(_WINDOW_S))
    success = F.when(F.col("consumed") > 0, F.col("acked") * F.lit(100.0) / F.col("consumed"))
    return _five_minutes(spark, d).select("start", rate("retried").alias("retry_rate"), rate("dead").alias("dead_letter_rate"), success.alias("success_pct"))


@P.add(f"with {EV}, {_R5} " + _HELD_FOR.format(f"dead > {_DLQ_RATE * _WINDOW_S}", 1))
def alert_dlq_rate(spark, d):
    """More than one dead letter a second for five minutes."""
    return stats.held(_five_minutes(spark, d), "start", F.col("dead") > _DLQ_RATE * _WINDOW_S, _WINDOW_S, 1)


@P.add(f"with {EV}, {_R5} " + _HELD_FOR.format(f"published - consumed > {_LAG_RATE * _WINDOW_S}", 2))
def alert_lag(spark, d):
    """Publishing ahead of consuming by more than a hundred messages a second for ten minutes."""
    return stats.held(_five_minutes(spark, d), "start", F.col("published") - F.col("consumed") > _LAG_RATE * _WINDOW_S, _WINDOW_S, 2)


@P.add(f"with {EV}, {_R5} " + _HELD_FOR.format("published - consumed > 0", 2))
def lag_periods(spark, d):
    """Ten minutes and more of publishing ahead of consuming at all."""
    return stats.held(_five_minutes(spark, d), "start", F.col("published") - F.col("consumed") > 0, _WINDOW_S, 2)


@P.add(f"with {EV}, {_H} select hour, published, greatest(0, published - coalesce(lag(published) over (order by hour), published)) as delta from h")
def throughput_delta(spark, d):
    w = Window.orderBy("hour")  # one row per hour
    return _hours(spark, d).select("hour", "published", F.greatest(F.lit(0), F.col("published") - F.coalesce(F.lag("published").over(w), F.col("published"))).alias("delta"))


@P.add(f"with {EV}, {_H} select hour, published, consumed from h order by hour desc limit 30")
def history_30(spark, d):
    return _hours(spark, d).select("hour", "published", "consumed").orderBy(F.desc("hour")).limit(30)


@P.add(f"with {EV}, {_H} select hour, cast(sum(published - consumed) over (order by hour) as bigint) as lag from h")
def consumer_lag(spark, d):
    w = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)  # one row per hour
    return _hours(spark, d).select("hour", F.sum(F.col("published") - F.col("consumed")).over(w).alias("lag"))


@P.add(f"with {EV} select op, count(distinct key) as consumers from ev group by 1")
def distinct_consumers(spark, d):
    return events(spark, d).groupBy("op").agg(F.countDistinct("key").alias("consumers"))


@P.add(f"with {EV} select op, key, count(*) as n from ev group by rollup (op, key)")
def stats_rollup(spark, d):
    """Depth per queue and user with subtotals; an addition to what brokers report."""
    return events(spark, d).rollup("op", "key").agg(F.count("*").alias("n"))


@P.add(f"with {MSG} select topic, count(*) as depth from msg group by 1 order by 1")
def topics_sorted(spark, d):
    return messages(spark, d).groupBy("topic").agg(F.count("*").alias("depth")).orderBy("topic")


@P.add(f"with {MSG} select topic, count(*) as depth from msg group by 1 order by depth desc, topic limit 5")
def top5_topics(spark, d):
    return messages(spark, d).groupBy("topic").agg(F.count("*").alias("depth")).orderBy(F.desc("depth"), "topic").limit(5)


@P.add(f"with {CMD} select cmd_type, count(*) as n from cmd group by 1")
def command_histogram(spark, d):
    return commands(spark, d).groupBy("cmd_type").agg(F.count("*").alias("n"))


# Replay


@P.add(f"with {WAL} select node_id, lsn, msg_id, topic from wal where rec_type = 1")
def wal_publishes(spark, d):
    return wal(spark, d).where(F.col("rec_type") == 1).select("node_id", "lsn", "msg_id", "topic")


@P.add(f"with {WAL} select node_id, count(*) as records, cast(sum(octet_length(encode(coalesce(payload, msg_id, ''))) + 9) as bigint) as bytes from wal group by 1")
def wal_size(spark, d):
    size = wal_record_bytes(F.coalesce("payload", "msg_id", F.lit("")))
    return wal(spark, d).groupBy("node_id").agg(F.count("*").alias("records"), F.sum(size).alias("bytes"))


_BAD = "(rec_type is null or rec_type not between 1 and 6)"


@P.add(f"""with {WAL}, bad as (select node_id, min(lsn) as upto from wal where {_BAD} group by 1)
  select wal.node_id, lsn from wal left join bad using (node_id) where lsn < coalesce(upto, 9223372036854775807)""")
def wal_valid_prefix(spark, d):
    """Records before the first one that can't be read (here: of unknown type) on their node."""
    log = wal(spark, d).select("node_id", "lsn", "rec_type")
    bad = log.where(F.expr(_BAD)).groupBy("node_id").agg(F.min("lsn").alias("upto"))
    # a node is one row there, and nodes are few: one per broker of a cluster
    return log.join(bad, "node_id", "left").where(F.col("lsn") < F.coalesce("upto", F.lit(9223372036854775807))).select("node_id", "lsn")


@P.add(f"""with {WAL}, r as (select node_id, msg_id, lsn, rec_type, row_number() over (partition by node_id, msg_id order by lsn desc) as rn from wal where rec_type in (1, 2) and msg_id is not null)
  select node_id as feed, msg_id, lsn as pos from r where rn = 1 and rec_type = 1""")
def snapshot_plus_tail(spark, d):
    """A snapshot of the logs' state at lsn 1000 and the changes after it."""
    log = wal(spark, d).select(F.col("node_id").alias("feed"), F.col("lsn").alias("pos"), F.col("rec_type").alias("kind"), "msg_id")
    args = ("feed", "msg_id", "pos", "kind", WAL_PUBLISH, WAL_ACK)
    snapshot = apply_changes(log.limit(0), log.where(F.col("pos") <= 1000), *args)
    return apply_changes(snapshot, log.where(F.col("pos") > 1000), *args)


def _bindings(log):
    """(exchange_name, queue_name, binding_key, n) of a command log; see bindings_active."""
    key = ["exchange_name", "queue_name", "binding_key"]
    gone = log.where(F.col("cmd_type") == 12).groupBy("exchange_name").agg(F.max("seq").alias("gone"))
    steps = (
        log.where(F.col("cmd_type").isin(13, 14)).join(gone, "exchange_name", "left").where(F.col("seq") > F.coalesce("gone", F.lit(-1)))
        .select(*key, "seq", F.when(F.col("cmd_type") == 13, 1).otherwise(-1).cast("long").alias("step"))
    )
    walked = running(steps, key, "seq", {"total": ("sum", F.col("step"))}, inclusive=True)
    n = F.sum("step") - F.least(F.lit(0), F.min("total"))
    return walked.groupBy(*key).agg(n.alias("n")).where(F.col("n") > 0)


def _exchanges(log):
    """(exchange_name, exchange_type) declared since they were last deleted."""
    own = log.where(F.col("cmd_type").isin(11, 12) & F.col("exchange_name").isNotNull())
    gone = own.groupBy("exchange_name").agg(F.max(F.when(F.col("cmd_type") == 12, F.col("seq"))).alias("gone"))
    declared = own.where((F.col("cmd_type") == 11) & F.col("exchange_type").isNotNull()).join(gone, "exchange_name")
    return declared.where(F.col("seq") > F.coalesce("gone", F.lit(-1))).groupBy("exchange_name").agg(F.min_by("exchange_type", "seq").alias("exchange_type"))


_BOUND = """dels as (select exchange_name, max(seq) as gone from cmd where cmd_type = 12 group by 1),
  b as (select c.exchange_name, queue_name, binding_key, seq, case cmd_type when 13 then 1 else -1 end as step from cmd c left join dels using (exchange_name)
    where cmd_type in (13, 14) and c.exchange_name is not null and queue_name is not null and binding_key is not null and seq > coalesce(gone, -1)),
  s as (select *, sum(step) over (partition by exchange_name, queue_name, binding_key order by seq) as total from b)"""
_EXCH = """ex as (select exchange_name, exchange_type, seq, cmd_type, coalesce(max(case when cmd_type = 12 then seq end) over (partition by exchange_name), -1) as gone from cmd
  where cmd_type in (11, 12) and exchange_name is not null)"""


@P.add(f"""with recursive {CMD}, {LIVES}, {_SUBS}, {_BOUND}, {_EXCH}
  select 'message' as kind, coalesce(topic, '') as name, msg_id as detail, cast(1 as bigint) as n from life where purge = 9223372036854775807 and ack = 9223372036854775807
  union all select 'subscriber', topic, subscriber_id, 1 from subs
  union all select 'exchange', exchange_name, arg_min(exchange_type, seq), 1 from ex where cmd_type = 11 and seq > gone and exchange_type is not null group by 2
  union all select 'binding', exchange_name, queue_name || ' ' || binding_key, cast(sum(step) - least(0, min(total)) as bigint) from s group by 2, 3, queue_name, binding_key having sum(step) - least(0, min(total)) > 0""")
def restore_full_state(spark, d):
    """A snapshot of messages, subscribers, exchanges and bindings at half the log, restored, and the rest of the log applied to it.

    A snapshot is a log of what would make its state: that's how the rest goes on from it.
    """
    raft, log = table(spark, d, "raft_commands"), commands(spark, d)
    half = (log.agg(F.max("seq")).first()[0] or 0) // 2
    early, shape = log.where(F.col("seq") <= half), ["seq", "cmd_type", "msg_id", "topic", "subscriber_id", "exchange_name", "exchange_type", "queue_name", "binding_key"]

    def rows(df, bucket, kind, **columns):
        have = {"seq": F.lit(half).cast("long"), "cmd_type": F.lit(kind), **columns}
        return df.select(F.lit(bucket).alias("bucket"), *[have.get(c, F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in shape])

    state = [
        rows(raft_state(raft.where(F.col("log_index") <= half)), "messages", 1, seq=F.col("pos")), rows(subscriptions(early), "subscribers", 9, seq=F.col("from_seq")),
        rows(_exchanges(early), "exchanges", 11), rows(_bindings(early).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))), "bindings", 13),
    ]
    path = fresh_dir(spark, "full-state")
    write_snapshot(reduce(DataFrame.unionByName, state), path)
    back = read_snapshot(spark, path)
    base = back.where(F.col("bucket") == "messages").select("msg_id", "topic", F.col("seq").alias("pos"))
    whole = back.where(F.col("bucket") != "messages").select(*shape).unionByName(log.where(F.col("seq") > half).select(*shape))
    out = lambda df, kind, name, detail, n=F.lit(1): df.select(F.lit(kind).alias("kind"), name.alias("name"), detail.alias("detail"), n.cast("long").alias("n"))
    return reduce(DataFrame.unionByName, [
        out(raft_state(raft.where(F.col("log_index") > half), base), "message", F.coalesce("topic", F.lit("")), F.col("msg_id")),
        out(subscriptions(whole), "subscriber", F.col("topic"), F.col("subscriber_id")), out(_exchanges(whole), "exchange", F.col("exchange_name"), F.col("exchange_type")),
        out(_bindings(whole), "binding", F.col("exchange_name"), F.concat_ws(" ", "queue_name", "binding_key"), F.col("n")),
    ])


@P.add(f"""with {CMD}, {_BOUND}
  select exchange_name, queue_name, binding_key, cast(sum(step) - least(0, min(total)) as bigint) as n from s group by all having sum(step) - least(0, min(total)) > 0""")
def bindings_active(spark, d):
    """Bindings and how often each is bound. An unbind of nothing does nothing: the walk is floored at 0 at each step,
    which its sum and its lowest point give without replaying it. Deleting an exchange ends its bindings."""
    return _bindings(commands(spark, d))




@P.add(f"with {CMD}, {_EXCH} select exchange_name, arg_min(exchange_type, seq) as exchange_type from ex where cmd_type = 11 and seq > gone and exchange_type is not null group by 1")
def exchanges_active(spark, d):
    """Exchanges declared since they were last deleted, with the type of the first declaration."""
    return _exchanges(commands(spark, d))


@P.add(f"""with {CMD}, first as (select exchange_name, arg_min(exchange_type, seq) as kind from cmd where cmd_type = 11 and exchange_name is not null and exchange_type is not null group by 1)
  select seq, c.exchange_name, exchange_type from cmd c join first using (exchange_name) where cmd_type = 11 and exchange_type <> kind""")
def exchange_conflicts(spark, d):
    """Declarations of another type than the exchange's first."""
    declared = commands(spark, d).where((F.col("cmd_type") == 11) & F.col("exchange_name").isNotNull() & F.col("exchange_type").isNotNull())
    first = declared.groupBy("exchange_name").agg(F.min_by("exchange_type", "seq").alias("kind"))
    return declared.join(first, "exchange_name").where(F.col("exchange_type") != F.col("kind")).select("seq", "exchange_name", "exchange_type")


@P.add(f"""with o as (select o_orderkey as seq, o_orderstatus as queue, cast(least(greatest(11 - 2 * cast(left(o_orderpriority, 1) as int), 0), 9) as int) as lvl from orders)
  select queue, lvl, count(*) as n, min(seq) as first_seq from o group by all""")
def order_queues(spark, d):
    """Orders as a second queue workload: depth and first order per status and level."""
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("queue"), clamp_priority(F.lit(11) - 2 * F.left("o_orderpriority", F.lit(1)).cast("int")).alias("lvl")
    )
    return o.groupBy("queue", "lvl").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
