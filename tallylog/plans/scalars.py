"""Queries of per-row rules and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallylog.functions import envelope
from tallylog.functions import scalars as S
from tallylog.functions.ids import derived_id
from tallylog.plans.base import AS_OF, AS_OF_EVENTS, EV, MSG, Plans, events, messages
from tallylog.sources.tables import table

P = Plans()
#: A number per event for the formatting rules, from 0 up to billions.
_BIG_SQL = "(seq * seq * 137)"


def _big():
    return F.col("seq") * F.col("seq") * 137


@P.add(f"with {MSG} select seq, md5(cast(seq as varchar)) as id, 0 as retry, 5 as max_retry from msg")
def message_envelope(spark, d):
    return messages(spark, d).select("seq", derived_id(F.col("seq").cast("string")).alias("id"), F.lit(0).alias("retry"), F.lit(S.DEFAULT_MAX_RETRY).alias("max_retry"))


@P.add(f"""with {MSG} select seq, 5 as max_retry, case when delay_ns > 0 then ts_ns + delay_ns else 0 end as deliver_at,
  case when ttl_ns > 0 then ts_ns + ttl_ns else 0 end as expires_at from msg""")
def publish_normalize(spark, d):
    due = lambda c: F.when(F.col(c) > 0, F.col("ts_ns") + F.col(c)).otherwise(F.lit(0).cast("long"))
    return messages(spark, d).select("seq", F.lit(S.DEFAULT_MAX_RETRY).alias("max_retry"), due("delay_ns").alias("deliver_at"), due("ttl_ns").alias("expires_at"))


@P.add(f"with {MSG} select seq, priority, lvl from msg")
def priority_clamp(spark, d):
    return messages(spark, d).select("seq", "priority", "lvl")


@P.add(f"with {MSG} select topic, lvl, count(*) as n from msg group by all")
def priority_histogram(spark, d):
    return messages(spark, d).groupBy("topic", "lvl").agg(F.count("*").alias("n"))


@P.add(f"with {EV} select seq, case when seq <= 1 then cast(1 as bigint) else cast(1 as bigint) << cast(length(bin(seq - 1)) as int) end as capacity from ev")
def next_pow2(spark, d):
    return events(spark, d).select("seq", S.next_power_of_two(F.col("seq")).alias("capacity"))


@P.add(f"with {MSG} select distinct topic || '_dead_letter' as dlq, topic as source from msg")
def dlq_source_name(spark, d):
    names = messages(spark, d).select(S.dead_letter_name(F.col("topic")).alias("dlq")).distinct()
    return names.select("dlq", S.dead_letter_source(F.col("dlq")).alias("source"))


@P.add(f"""with {EV}, t as (select seq, list_filter(list_transform(string_split(' n' || key || ' , ,' || op || ',n' || key || ',z,, ' || op, ','), lambda s: trim(s)), lambda s: s <> '') as l from ev)
  select seq, array_to_string(list_filter(l, lambda s, i: list_position(l, s) = i), '|') as seeds from t""")
def seed_list(spark, d):
    text = F.concat(F.lit(" n"), F.col("key").cast("string"), F.lit(" , ,"), F.col("op"), F.lit(",n"), F.col("key").cast("string"), F.lit(",z,, "), F.col("op"))
    return events(spark, d).select("seq", F.array_join(S.seed_list(text), "|").alias("seeds"))


@P.add(f"""with {EV}, t as (select seq, case when seq % 3 = 0 then op else op || '@10.0.0.' || key end as text from ev)
  select seq, split_part(text, '@', 1) as peer, coalesce(nullif(split_part(text, '@', 2), ''), text) as addr from t""")
def peer_split(spark, d):
    text = F.when(F.col("seq") % 3 == 0, F.col("op")).otherwise(F.concat("op", F.lit("@10.0.0."), F.col("key").cast("string")))
    return events(spark, d).select("seq", S.peer_id(text).alias("peer"), S.peer_address(text).alias("addr"))


_EXP = f"case when ttl_ns = 0 then 0 else ts_ns + ttl_ns end"


@P.add(f"""with {EV} select seq, case when ttl_ns = 0 then -1 when ts_ns + ttl_ns <= {AS_OF_EVENTS} then 0 else (ts_ns + ttl_ns - {AS_OF_EVENTS}) // 1000000 end as ttl_ms from ev""")
def kv_remaining_ttl(spark, d):
    expires = F.when(F.col("ttl_ns") == 0, F.lit(0)).otherwise(F.col("ts_ns") + F.col("ttl_ns"))
    return events(spark, d).select("seq", S.remaining_ttl_ms(expires, AS_OF_EVENTS).alias("ttl_ms"))


@P.add(f"with {MSG} select seq, coalesce(json_valid(payload), false) as valid from msg")
def json_valid(spark, d):
    return messages(spark, d).select("seq", S.is_json(F.col("payload")).alias("valid"))


@P.add(f"""with {EV}, t as (select seq, case seq % 3 when 0 then '"' || op || ' \\"x\\""' when 1 then op else cast(k as varchar) end as text from ev)
  select seq, case when json_valid(text) and json_type(text) = 'VARCHAR' then json_extract_string(text, '$') else text end as value from t""")
def kv_unwrap(spark, d):
    text = F.when(F.col("seq") % 3 == 0, F.concat(F.lit('"'), F.col("op"), F.lit(' \\"x\\""'))).when(F.col("seq") % 3 == 1, F.col("op")).otherwise(F.col("k").cast("string"))
    return events(spark, d).select("seq", S.unwrap_json_string(text).alias("value"))


@P.add(f"""with {EV}, t as (select seq, trim(case seq % 7 when 0 then ' ' || k || ' ' when 1 then '  ' when 2 then 'x1' when 3 then '1.5' when 4 then '+3' when 5 then '-' || k else '99999999999999999999' end) as text from ev)
  select seq, case when text = '' then 0 when regexp_full_match(text, '[+-]?[0-9]+') then try_cast(ltrim(text, '+') as bigint) end::bigint as value from t""")
def kv_parse_int(spark, d):
    k = F.col("k").cast("string")
    text = (
        F.when(F.col("seq") % 7 == 0, F.concat(F.lit(" "), k, F.lit(" "))).when(F.col("seq") % 7 == 1, F.lit("  ")).when(F.col("seq") % 7 == 2, F.lit("x1"))
        .when(F.col("seq") % 7 == 3, F.lit("1.5")).when(F.col("seq") % 7 == 4, F.lit("+3")).when(F.col("seq") % 7 == 5, F.concat(F.lit("-"), k)).otherwise(F.lit("99999999999999999999"))
    )
    return events(spark, d).select("seq", S.parse_int(text).alias("value"))


@P.add(f"""with {EV}, n as (select seq, {_BIG_SQL} as n from ev) select seq, case
  when n >= 1000000 then ((n + 5000) // 10000) // 100 || '.' || lpad(cast(((n + 5000) // 10000) % 100 as varchar), 2, '0') || 'M'
  when n >= 1000 then ((n + 50) // 100) // 10 || '.' || ((n + 50) // 100) % 10 || 'K' else cast(n as varchar) end as shown from n""")
def fmt_number(spark, d):
    return events(spark, d).select("seq", S.format_number(_big()).alias("shown"))


@P.add(f"""with {EV}, n as (select seq, {_BIG_SQL} as n from ev),
  u as (select seq, n, case when n >= 1099511627776 then 4 when n >= 1073741824 then 3 when n >= 1048576 then 2 when n >= 1024 then 1 else 0 end as i from n),
  h as (select seq, n, i, (n * 200 + (cast(1 as bigint) << (10 * i))) // (2 * (cast(1 as bigint) << (10 * i))) as h from u)
  select seq, case when n = 0 then '0 B' else (h // 100) || case when h % 100 = 0 then '' when h % 10 = 0 then '.' || (h % 100) // 10
    else '.' || lpad(cast(h % 100 as varchar), 2, '0') end || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][i + 1] end as shown from h""")
def fmt_bytes(spark, d):
    return events(spark, d).select("seq", S.format_bytes(_big()).alias("shown"))


@P.add(f"""with {EV}, s as (select seq, {_BIG_SQL} // 1000 as s from ev) select seq,
  case when s // 3600 < 10 then '0' else '' end || s // 3600 || ':' || lpad(cast((s % 3600) // 60 as varchar), 2, '0') || ':' || lpad(cast(s % 60 as varchar), 2, '0') as shown from s""")
def fmt_uptime(spark, d):
    return events(spark, d).select("seq", S.format_uptime(_big()).alias("shown"))


@P.add(f"""with {EV}, n as (select seq, {_BIG_SQL} as n from ev) select seq, case when n < 1000 then n || 'ms' when n < 60000 then (n + 500) // 1000 || 's'
  when n < 3600000 then (n + 30000) // 60000 || 'm' else ((n + 180000) // 360000) // 10 || '.' || ((n + 180000) // 360000) % 10 || 'h' end as shown from n""")
def fmt_ttl(spark, d):
    return events(spark, d).select("seq", S.format_ttl(_big()).alias("shown"))


@P.add(f"with {MSG} select seq, case when length(payload) > 80 then substring(payload, 1, 80) || '...' else payload end as shown from msg")
def truncate_value(spark, d):
    return messages(spark, d).select("seq", S.truncate_value(F.col("payload")).alias("shown"))


@P.add(f"with {EV} select seq, least(cast(k as double) / 80.0 * 100, 100.0) as pct from ev")
def gauge_pct(spark, d):
    return events(spark, d).select("seq", S.gauge_percent(F.col("k"), 80).alias("pct"))


@P.add(f"with {MSG} select seq, octet_length(encode(coalesce(payload, ''))) + 9 as bytes from msg")
def wal_record_size(spark, d):
    return messages(spark, d).select("seq", S.wal_record_bytes(F.coalesce("payload", F.lit(""))).alias("bytes"))


@P.add(f"with {MSG} select seq from msg where octet_length(encode(coalesce(payload, ''))) <= 4194304")
def frame_limit(spark, d):
    return messages(spark, d).where(F.coalesce(F.octet_length("payload"), F.lit(0)) <= S.MAX_FRAME_BYTES).select("seq")


HEADERS_SQL = "case when headers is null then null else coalesce(array_to_string(list_sort(list_transform(map_entries(headers), lambda e: e.key || '=' || coalesce(e.value, ''))), '&'), '') end"
_WIRE = ", ".join(f"{HEADERS_SQL if n == 'headers' else c} as {n}" for n, (c, _) in envelope.FIELDS.items())


@P.add(f"select row_id as seq, {_WIRE} from messages")
def json_roundtrip(spark, d):
    """Every message's whole envelope to JSON and back."""
    back = table(spark, d, "messages").select(F.col("row_id").alias("seq"), envelope.encode().alias("line")).select("seq", envelope.decode(F.col("line")).alias("m"))
    return back.select("seq", *[envelope.headers_text(F.col("m.headers")).alias(n) if n == "headers" else F.col(f"m.{n}") for n in envelope.FIELDS])


@P.add(f"with {MSG} select seq from msg where expires_at > 0 and {AS_OF} > expires_at")
def ttl_expired(spark, d):
    return messages(spark, d).where((F.col("expires_at") > 0) & (F.lit(AS_OF) > F.col("expires_at"))).select("seq")


@P.add(f"with {MSG} select seq from msg where (expires_at > 0 and expires_at <= {AS_OF}) or (ttl_ns > 0 and ts_ns + ttl_ns <= {AS_OF})")
def ttl_recovery(spark, d):
    at = F.lit(AS_OF)
    gone = ((F.col("expires_at") > 0) & (F.col("expires_at") <= at)) | ((F.col("ttl_ns") > 0) & (F.col("ts_ns") + F.col("ttl_ns") <= at))
    return messages(spark, d).where(gone).select("seq")


@P.add(f"with {MSG} select seq, topic, deliver_at from msg where delay_ns > 0 and {AS_OF} >= deliver_at")
def delayed_ready(spark, d):
    return messages(spark, d).where((F.col("delay_ns") > 0) & (F.lit(AS_OF) >= F.col("deliver_at"))).select("seq", "topic", "deliver_at")


_STATE = f"""case when expires_at > 0 and {AS_OF} > expires_at then 'expired' when ts_ns > {AS_OF} then 'future'
  when retry > max_retry then 'dead' when deliver_at > {AS_OF} then 'delayed' else 'ready' end"""


def state_of(as_of: int):
    """The bucket a message is in at an instant; exactly one holds."""
    return (
        F.when((F.col("expires_at") > 0) & (F.lit(as_of) > F.col("expires_at")), "expired")
        .when(F.col("ts_ns") > as_of, "future")
        .when(S.is_dead(F.col("retry"), F.col("max_retry")), "dead")
        .when(F.col("deliver_at") > as_of, "delayed")
        .otherwise("ready")
    )


@P.add(f"with {MSG} select topic, {_STATE} as state, count(*) as n from msg group by all")
def lifecycle_state(spark, d):
    return messages(spark, d).groupBy("topic", state_of(AS_OF).alias("state")).agg(F.count("*").alias("n"))


_GONE = f"(expires_at > 0 and expires_at <= {AS_OF}) or (ttl_ns > 0 and ts_ns + ttl_ns <= {AS_OF})"


def _gone():
    """Expired by either clock that recovery looks at."""
    return ((F.col("expires_at") > 0) & (F.col("expires_at") <= AS_OF)) | ((F.col("ttl_ns") > 0) & (F.col("ts_ns") + F.col("ttl_ns") <= AS_OF))


@P.add(f"with {MSG} select seq, case when {_GONE} then 'dropped' when deliver_at > {AS_OF} then 'delayed' else 'queued' end as state from msg")
def recover_state(spark, d):
    state = F.when(_gone(), "dropped").when(F.col("deliver_at") > AS_OF, "delayed").otherwise("queued")
    return messages(spark, d).select("seq", state.alias("state"))


@P.add("""select row_id as seq, case when topic is null or topic = '' then 'topic' when id is null or trim(id, ' ') = '' then 'id' else 'routing_key' end as missing
  from messages where coalesce(topic, '') = '' or trim(coalesce(id, ''), ' ') = '' or (exchange_name <> '' and coalesce(routing_key, '') = '')""")
def reject_invalid(spark, d):
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    missing = (
        F.when(F.coalesce("topic", F.lit("")) == "", "topic").when(blank("id"), "id")
        .when((F.col("exchange_name") != "") & (F.coalesce("routing_key", F.lit("")) == ""), "routing_key")
    )
    return table(spark, d, "messages").select(F.col("row_id").alias("seq"), missing.alias("missing")).where(F.col("missing").isNotNull())


_TIMEOUT = 30_000_000_000


@P.add(f"with {EV} select seq, ts_ns + {_TIMEOUT} as ack_deadline, {AS_OF_EVENTS} > ts_ns + {_TIMEOUT} as timed_out from ev where op = 'view'")
def pending_deadline(spark, d):
    deadline = F.col("ts_ns") + _TIMEOUT
    return events(spark, d).where(F.col("op") == "view").select("seq", deadline.alias("ack_deadline"), (F.lit(AS_OF_EVENTS) > deadline).alias("timed_out"))


@P.add(f"""with {EV} select seq, cast(least(nacks + 1, 6) as bigint) as retry, nacks + 1 > 5 as dead from ev where op = 'view' and {AS_OF_EVENTS} > ts_ns + {_TIMEOUT}""")
def timeout_requeue(spark, d):
    late = events(spark, d).where((F.col("op") == "view") & (F.lit(AS_OF_EVENTS) > F.col("ts_ns") + _TIMEOUT))
    retry = F.col("nacks") + 1
    return late.select("seq", F.least(retry, F.lit(S.DEFAULT_MAX_RETRY + 1)).cast("long").alias("retry"), (retry > S.DEFAULT_MAX_RETRY).alias("dead"))


@P.add("select cast(n as bigint) as attempt, cast(least(pow(2, n), 30) as bigint) as wait_s from range(1, 16) t(n)")
def backoff_schedule(spark, d):
    return spark.range(1, 16).select(F.col("id").alias("attempt"), F.least(F.pow(F.lit(2), F.col("id")), F.lit(30)).cast("long").alias("wait_s"))
