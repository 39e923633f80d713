"""Which queues a message goes to: direct, fan-out, wildcard topics and headers.

Messages carry exchange, routing_key and headers; bindings are rows (exchange,
queue, binding_key, headers, match_all). A queue bound several times gets one
copy. Bindings are few as a rule: up to INLINE of them are compiled into one
expression, evaluated where the message lies, without join or shuffle. Beyond, the
bindings are a table with a row per queue, joined with the distinct routing keys (or
sets of headers), which lead back to their messages; arriving messages of a stream
are joined with it themselves.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.functions.ids import derived_id
from tallylog.operators.joins import join_counted
from tallylog.session import parallelism

#: Bindings that are compiled into an expression; a checked bound.
INLINE = 200


def topic_regex(pattern: str) -> str:
    """The regular expression for '.' + routing key: '*' is one word, '#' any number of words."""
    one, many = r"\.[^.]*", r"(\.[^.]*)*"
    return "^" + "".join(one if s == "*" else many if s == "#" else r"\." + re.escape(s) for s in pattern.split(".")) + "$"


def topic_matches(key: Column, pattern: str) -> Column:
    """Whether a routing key matches a pattern; patterns without wildcards compare, '#' takes every key but null."""
    if pattern == "#":
        return key.isNotNull()
    if not {"*", "#"} & set(pattern.split(".")):
        return key == pattern
    return F.concat(F.lit("."), key).rlike(topic_regex(pattern))


def header_value(headers: Column, name: str) -> Column:
    """A header; one that isn't there reads as ''."""
    return F.coalesce(F.try_element_at(headers, F.lit(name)), F.lit(""))


def headers_match(headers: Column, wanted: dict[str, str], match_all: bool) -> Column:
    """All, or any, of the wanted headers; nothing wanted is always true."""
    if not wanted:
        return F.lit(True)
    tests = [header_value(headers, k) == v for k, v in sorted(wanted.items())]
    result = tests[0]
    for t in tests[1:]:
        result = (result & t) if match_all else (result | t)
    return result


def _inline(messages: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """Each message once per distinct queue among the rules (exchange, queue, condition) that hold."""
    by_queue: dict[tuple[str, str], Column] = {}
    for exchange, queue, test in rules:
        key = (exchange, queue)
        by_queue[key] = by_queue[key] | test if key in by_queue else test
    hits = [F.when((F.col("exchange") == e) & F.coalesce(test, F.lit(False)), F.lit(q)) for (e, q), test in by_queue.items()]
    if not hits:
        return messages.limit(0).withColumn("queue", F.lit(""))
    return messages.withColumn("queue", F.explode(F.array_distinct(F.array_compact(F.array(*hits)))))


def _pattern_regex(pattern: Column) -> Column:
    """topic_regex as an expression."""
    quoted = lambda s: F.concat(F.lit(r"\.\Q"), F.replace(s, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    part = lambda s: F.when(s == "#", F.lit(r"(\.[^.]*)*")).when(s == "*", F.lit(r"\.[^.]*")).otherwise(quoted(s))
    return F.concat(F.lit("^"), F.array_join(F.transform(F.split(pattern, r"\.", -1), part), ""), F.lit("$"))


def _joined(rows: DataFrame, bindings: DataFrame, kind: str) -> DataFrame:
    """rows with column `queue` by a join with the table of bindings, one row of it per queue.

    Few exchanges take all messages, so their join would be one task's work: rows are
    spread over as many salts as tasks run, and the bindings go to each. Rows may be a
    stream.
    """
    salts = parallelism(rows.sparkSession)
    rule = F.struct(_pattern_regex(F.coalesce("binding_key", F.lit(""))).alias("regex"), F.col("binding_key").alias("key"), F.map_entries("headers").alias("headers"), F.col("match_all").alias("all"))
    rules = bindings.groupBy(F.col("exchange").alias("__exchange"), F.col("queue").alias("__queue")).agg(F.collect_set(rule).alias("__rules"))
    rules = rules.withColumn("__of", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("routing_key") if "routing_key" in rows.columns else F.lit(0), F.lit(salts)).cast("int"))
    key = F.concat(F.lit("."), F.col("routing_key")) if kind in ("topic", "direct") else F.lit("")
    value = lambda e: F.coalesce(F.try_element_at(F.col("headers"), e["key"]), F.lit("")) == e["value"]

    def fits(r: Column) -> Column:
        if kind == "direct":
            return r["key"] == F.col("routing_key")
        if kind == "topic":
            return F.rlike(key, r["regex"])
        if kind == "fanout":
            return F.lit(True)
        wanted = F.coalesce(r["headers"], F.array().cast("array<struct<key:string,value:string>>"))
        return (F.size(wanted) == 0) | F.when(F.coalesce(r["all"], F.lit(False)), F.forall(wanted, value)).otherwise(F.exists(wanted, value))

    test = (F.col("exchange") == F.col("__exchange")) & (F.col("__salt") == F.col("__of")) & F.exists("__rules", fits)
    return salted.join(rules, test).withColumn("queue", F.col("__queue")).drop("__exchange", "__queue", "__rules", "__of", "__salt")


def route(messages: DataFrame, bindings: DataFrame, kind: str) -> DataFrame:
    """messages with column `queue`, one row per queue that a binding of the message's exchange selects.

    kind: 'direct' (equal keys), 'fanout' (every binding), 'topic' (wildcards) or
    'headers'. A null exchange or routing key matches nothing, except that fan-out
    and headers don't look at the key. Messages without a match don't come out.
    """
    tests = {
        "direct": lambda b: F.col("routing_key") == b["binding_key"],
        "fanout": lambda b: F.lit(True),
        "topic": lambda b: topic_matches(F.col("routing_key"), b["binding_key"]),
        "headers": lambda b: headers_match(F.col("headers"), dict(b["headers"] or {}), bool(b["match_all"])),
    }
    few = bindings.limit(INLINE + 1).collect()
    if len(few) <= INLINE:
        return _inline(messages, [(b["exchange"], b["queue"], tests[kind](b)) for b in few])
    if messages.isStreaming:
        return _joined(messages, bindings, kind)
    # many bindings: find the queues of each distinct key once, then let the keys lead back to the messages
    if kind == "fanout":
        key, rows = ["exchange"], messages
    elif kind == "headers":
        key, rows = ["exchange", "__headers"], messages.withColumn("__headers", F.coalesce(F.to_json("headers"), F.lit("")))
    else:
        key, rows = ["exchange", "routing_key"], messages
    copies = F.count("*").alias("__copies")
    keys = rows.groupBy(*key).agg(copies, F.first("headers").alias("headers")) if kind == "headers" else rows.groupBy(*key).agg(copies)
    if kind in ("direct", "fanout"):
        named = bindings.withColumnRenamed("binding_key", "routing_key")
        hits = keys.join(named.select(*key, "queue"), key)
    else:
        hits = _joined(keys, bindings, kind)
    queues = hits.groupBy(*key, "__copies").agg(F.collect_set("queue").alias("__queues"))
    found = join_counted(rows, queues, key, "__copies", messages.count())
    return found.select(*[F.col(c) for c in messages.columns], F.explode("__queues").alias("queue"))


def route_default(messages: DataFrame) -> DataFrame:
    """The default exchange: the routing key names the queue, the message stays itself."""
    return messages.where((F.col("exchange") == "") & F.col("routing_key").isNotNull()).withColumn("queue", F.col("routing_key"))


def clones(routed: DataFrame) -> DataFrame:
    """Routed messages as their queues' own: a new id from message and queue, the queue as topic."""
    return routed.withColumn("clone_id", derived_id("msg_id", "queue")).withColumn("topic", F.col("queue"))
