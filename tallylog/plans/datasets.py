"""Queries of the operators for message logs (p1 to p5), with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.functions.ids import canonical_id
from tallylog.operators import changes, drift, orphans, ranges
from tallylog.plans.base import CMD, WAL
from tallylog.session import materialized
from tallylog.sources.tables import table, table_path
from tallylog.streaming import dedup

#: Ten minutes, in nanoseconds.
SLACK_NS = 600_000_000_000


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "messages").select("topic", "row_id", "timestamp_ns")
    return ranges.late_rows(rows, "topic", "row_id", "timestamp_ns", SLACK_NS).select("topic", "row_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return changes.live_messages(table(spark, d, "wal_records"), table(spark, d, "raft_commands"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup.superfluous_copies(spark, table_path(d, "messages"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "message_files"))


def p4_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.whole_table(table(spark, d, "message_files"))


def p4_account(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the files, and how many of them the consistent table holds: readable, and at all."""
    whole = drift.whole_table(table(spark, d, "message_files"))
    rows = whole.groupBy("rec_id").agg(F.bool_or(F.coalesce(F.col("note") == "unreadable", F.lit(False))).alias("lost"), F.count("field").alias("n"))
    return rows.agg(F.count("*").alias("rec_ids"), F.count_if(~F.col("lost")).alias("readable"), F.sum("n").alias("cells"))


def p2_resume(spark: SparkSession, d: str) -> DataFrame:
    """p2_found in two halves: the state that the first half of each log leaves is the base of the second."""
    wal, raft = table(spark, d, "wal_records"), table(spark, d, "raft_commands")
    log = wal.select(F.col("node_id").alias("feed"), F.col("lsn").alias("pos"), F.col("rec_type").alias("kind"), canonical_id("msg_id").alias("msg_id"))
    args = ("feed", "msg_id", "pos", "kind", changes.WAL_PUBLISH, changes.WAL_ACK)
    cut, half = ((df.agg(F.max(c)).first()[0] or 0) // 2 for df, c in ((wal, "lsn"), (raft, "log_index")))
    base = changes.apply_changes(log.limit(0), log.where(F.col("pos") <= cut), *args)
    early = materialized(changes.raft_state(raft.where(F.col("log_index") <= half)), "early-state")
    later = changes.raft_state(raft.where(F.col("log_index") > half), early)
    return changes.apply_changes(base, log.where(F.col("pos") > cut), *args).unionByName(later.select(F.lit("raft").alias("feed"), "msg_id", "pos"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.message_orphans(*(table(spark, d, t) for t in ("wal_records", "raft_commands", "messages", "expired_messages")))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p4_table": p4_table, "p5_found": p5_found, "p2_resume": p2_resume, "p4_account": p4_account}

_ID = "nullif(lower(trim({0}, ' ')), '')"

SQL = {
    "p2_found": f"""
        with recursive {WAL}, {CMD},
        last as (select node_id, msg_id, lsn, rec_type, row_number() over (partition by node_id, msg_id order by lsn desc) as rn from wal where rec_type in (1, 2) and msg_id is not null),
        gone as (select msg_id, max(seq) as at from cmd where cmd_type = 2 group by 1),
        i as (select c.msg_id, c.seq as start, (select min(p.seq) from cmd p where p.cmd_type = 7 and p.topic = c.topic and p.seq > c.seq) as until
          from cmd c left join gone g on c.msg_id = g.msg_id where c.cmd_type = 1 and c.msg_id is not null and (g.at is null or c.seq > g.at)),
        nx as (select a.msg_id, a.start, a.until, (select min(b.start) from i b where b.msg_id = a.msg_id and b.start > a.until) as nxt from i a),
        life as (
          select nx.msg_id, start, until, nxt from nx join (select msg_id, min(start) as start from i group by 1) f using (msg_id, start)
          union all select nx.msg_id, nx.start, nx.until, nx.nxt from life join nx on nx.msg_id = life.msg_id and nx.start = life.nxt),
        u as (select msg_id, max(seq) as seq from cmd where cmd_type = 3 and msg_id is not null group by 1)
        select node_id as feed, msg_id, lsn as pos from last where rn = 1 and rec_type = 1
        union all
        select 'raft', life.msg_id, greatest(start, coalesce(u.seq, start)) from life left join u on u.msg_id = life.msg_id where until is null""",
    "p1_found": f"""
        select topic, row_id from (
          select topic, row_id, timestamp_ns, max(timestamp_ns) over (
            partition by topic order by row_id rows between unbounded preceding and 1 preceding) as seen
          from messages where topic is not null and timestamp_ns is not null)
        where seen - timestamp_ns > {SLACK_NS}""",
    "p3_found": f"""
        select msg_id, row_id from (
          select {_ID.format("id")} as msg_id, row_id, row_number() over (
            partition by {_ID.format("id")}
            order by delivery_count desc nulls last, retry desc nulls last, row_id) as rn
          from messages)
        where msg_id is not null and rn > 1""",
    "p4_found": f"""
        with recursive raw as (select rec_id, producer, file_no, {_ID.format('id')} as id, case when json_valid(payload) and json_type(payload) = 'OBJECT' then payload
            else (select case when json_valid(t) and json_type(t) = 'OBJECT' then t end from (select try(decode(from_base64(payload))) as t)) end as j
          from message_files where producer is not null and file_no is not null),
        files as (select producer, file_no, count(j) as readable, row_number() over (partition by producer order by file_no) as seq from raw group by 1, 2),
        rows as (select row_number() over () as r, seq, raw.producer, id, cast(j as json) as j from raw join files using (producer, file_no) where j is not null),
        f as (select r, k as path, json_extract(j, '$."' || k || '"') as v from rows, unnest(json_keys(j)) as t(k)
          union all select r, path || '.' || k, json_extract(v, '$."' || k || '"') from f, unnest(json_keys(v)) as t(k) where json_type(v) = 'OBJECT'),
        leaf as (select distinct on (r, path) producer, seq, id, r, path, v, case json_type(v) when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array'
            when 'DOUBLE' then case when contains(cast(v as varchar), '.') then 'decimal' else 'integer' end else 'integer' end as kind from f join rows using (r) where json_type(v) not in ('OBJECT', 'NULL')),
        kinds as (select producer, seq, path, kind, count(*) as n from leaf group by all),
        has as (select producer, seq, path, arg_max(kind, (n, kind)) as kind from kinds join files using (producer, seq) group by producer, seq, path, readable having sum(n) * 10 >= readable),
        gone as (select a.producer, a.seq + 1 as seq, a.path, a.kind from has a join files n on n.producer = a.producer and n.seq = a.seq + 1 where not exists (select 1 from has b where b.producer = a.producer and b.seq = a.seq + 1 and b.path = a.path)),
        come as (select b.producer, b.seq, b.path, b.kind from has b where b.seq > 1 and not exists (select 1 from has a where a.producer = b.producer and a.seq = b.seq - 1 and a.path = b.path)),
        val as (select producer, seq, id, path, case when json_type(v) in ('VARCHAR', 'BOOLEAN', 'ARRAY') then json_type(v) || cast(v as varchar) else 'n' || cast(cast(v as double) as varchar) end as x from leaf where id is not null),
        pair as (select g.producer, g.seq, g.path as old, c.path as new from gone g join come c on g.producer = c.producer and g.seq = c.seq and g.kind = c.kind
          join val a on a.producer = g.producer and a.seq = g.seq - 1 and a.path = g.path join val b on b.producer = c.producer and b.seq = c.seq and b.path = c.path and b.id = a.id
          group by all having count(distinct a.id) >= 3 and bool_and(a.x = b.x)),
        found as (select producer, seq, 'renamed' as change, old as field, new as to_value from pair
          union all select b.producer, b.seq, 'retyped', b.path, b.kind from has a join has b on a.producer = b.producer and a.seq = b.seq - 1 and a.path = b.path where a.kind <> b.kind
          union all select producer, seq, 'removed', path, '' from gone g where not exists (select 1 from pair p where p.producer = g.producer and p.seq = g.seq and p.old = g.path)
          union all select producer, seq, 'added', path, '' from come c where not exists (select 1 from pair p where p.producer = c.producer and p.seq = c.seq and p.new = c.path))
        select producer, file_no, change, field, to_value from found join files using (producer, seq)""",
    "p5_found": f"""
        with refs as (
          select 'wal_records' as src_table, rec_id as row_no, logged_at as t, {_ID.format("msg_id")} as key from wal_records where rec_type = 2
          union all
          select 'raft_commands', cmd_row, applied_at, {_ID.format("message_id")} from raft_commands where cmd_type in (2, 3, 6)),
        m as (select {_ID.format("id")} as key, min(received_at) as since from messages group by 1),
        x as (select {_ID.format("id")} as key, min(removed_at) as gone from expired_messages group by 1),
        k as (
          select src_table, row_no, t, case when m.key is null then 'missing' when x.gone < t then 'deleted' when m.since > t then 'late' end as orphan_kind
          from refs left join m on refs.key = m.key left join x on refs.key = x.key where refs.key is not null)
        select src_table, strftime(t at time zone 'UTC', '%Y-%m-%d') as ref_day, row_no, orphan_kind from k where orphan_kind is not null""",
}

SQL["p2_resume"] = SQL["p2_found"]
# values of rows that name a file; the table's rows without one are counted apart
_P4 = SQL["p4_found"]
SQL["p4_account"] = _P4[: _P4.index("kinds as (")].rstrip().rstrip(",") + """
        select (select count(distinct rec_id) from message_files) as rec_ids, (select count(distinct rec_id) from raw where j is not null) as readable,
          (select count(*) from leaf) as cells"""
