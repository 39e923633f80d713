"""A broker as an append-only table of commands and queries over it.

Every call appends commands, many at a time, or asks for a state at an instant.
Nothing is kept in memory: queues, pending messages, dead letters, bindings and
subscriptions are folds of the table. Times are nanoseconds and always given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallylog.functions.scalars import DEFAULT_MAX_RETRY, clamp_priority, dead_letter_name, queue_order
from tallylog.operators import queueing, routing
from tallylog.operators.joins import join_salted
from tallylog.operators.stats import long_format

#: One row per command; columns that an operation doesn't use are null.
COMMANDS = (
    "batch bigint, place bigint, op string, at_ns bigint, queue string, msg_id string, payload string, headers map<string,string>, priority int, retry int, "
    "delay_ns bigint, ttl_ns bigint, exchange string, exchange_type string, routing_key string, binding_key string, match_all boolean, subscriber string"
)
_COLUMNS = [c.split()[0] for c in COMMANDS.split(", ")]
_TYPES = dict(c.split() for c in COMMANDS.split(", "))

STATES = ("ready", "delayed", "pending", "dead", "acked", "expired", "purged")


class MessageLog:
    """Commands of one broker below `path`, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, max_retry: int = DEFAULT_MAX_RETRY, ack_timeout_ns: int = 30_000_000_000):
        self.spark, self.path, self.max_retry, self.ack_timeout_ns = spark, path.rstrip("/"), max_retry, ack_timeout_ns

    # the table

    def _version(self) -> int:
        """The newest complete version; a checkpoint that broke off left none."""
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        done = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/v*/n*/_SUCCESS"))
        return max((int(s.getPath().getParent().getParent().getName()[1:]) for s in done or []), default=-1)

    def _next_batch(self) -> int:
        """A number for a batch, claimed by a file that only one writer can make; no data is read."""
        jvm = self.spark.sparkContext._jvm
        claims = jvm.org.apache.hadoop.fs.Path(f"{self.path}/claims")
        fs = claims.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(claims)
        n = max((int(s.getPath().getName()) for s in fs.listStatus(claims)), default=0) + 1
        while not fs.createNewFile(jvm.org.apache.hadoop.fs.Path(claims, str(n))):
            n += 1
        return n

    def commands(self) -> DataFrame:
        """The command table; empty before the first command."""
        version = self._version()
        if version < 0:
            return self.spark.createDataFrame([], COMMANDS)
        return self.spark.read.schema(COMMANDS).parquet(f"{self.path}/v{version}/n*")

    def _append(self, op: str, at_ns: int, rows: DataFrame) -> int:
        batch = self._next_batch()
        have = {"batch": F.lit(batch), "place": F.monotonically_increasing_id(), "op": F.lit(op), "at_ns": F.lit(at_ns)}
        cells = [have.get(c, F.col(c) if c in rows.columns else F.lit(None)).cast(_TYPES[c]).alias(c) for c in _COLUMNS]
        rows.select(*cells).write.parquet(f"{self.path}/v{max(0, self._version())}/n{batch}")
        return batch

    def _one(self, op: str, at_ns: int, **cells) -> None:
        self._append(op, at_ns, self.spark.range(1).select(*[_literal(v).alias(c) for c, v in cells.items()]))

    # writing

    def publish(self, messages: DataFrame, at_ns: int) -> None:
        """messages: queue, msg_id and any of payload, headers, priority, delay_ns, ttl_ns. An id that was published before is a repeat."""
        self._append("publish", at_ns, _valid(messages, "queue", "msg_id"))

    def publish_exchange(self, messages: DataFrame, at_ns: int) -> None:
        """messages: exchange, routing_key, msg_id, headers and others; each goes to every queue that a binding selects, as its own copy."""
        messages = _valid(messages, "msg_id").withColumn("exchange", F.coalesce("exchange", F.lit("")))
        bindings, kinds = self.bindings(), self.exchanges()
        parts = [routing.route_default(messages)]
        for kind in ("direct", "fanout", "topic", "headers"):
            own = kinds.where(F.col("exchange_type") == kind).select("exchange")
            routed = routing.route(messages, bindings.join(own, "exchange", "left_semi"), kind)
            parts.append(routing.clones(routed).withColumn("msg_id", F.col("clone_id")).select(*messages.columns, "queue"))
        rows = parts[0].select(*messages.columns, "queue")
        for part in parts[1:]:
            rows = rows.unionByName(part)
        self._append("publish", at_ns, rows)

    def publish_topic(self, messages: DataFrame, at_ns: int) -> None:
        """messages: queue (the topic), msg_id, payload: for subscribers, not for a work queue."""
        self._append("publish_topic", at_ns, _valid(messages, "queue", "msg_id"))

    def consume(self, n: int, at_ns: int, queue: str | None = None) -> DataFrame:
        """Deliver the first n ready messages of each queue (or of one); they are pending from then on."""
        ready = self.ready(at_ns)
        first = queueing.head(ready if queue is None else ready.where(F.col("queue") == queue), n, "queue")
        batch = self._append("deliver", at_ns, first)
        return self.commands().where(F.col("batch") == batch).select("queue", "msg_id", "payload", "priority")

    def process(self, handle: Callable[[DataFrame], None], n: int, at_ns: int, queue: str | None = None) -> bool:
        """Deliver, hand the messages to `handle`, and acknowledge them; reject them all if it raises. Whether it went well."""
        sent = self.consume(n, at_ns, queue)
        try:
            handle(sent)
        except Exception:
            self.nack(sent.select("msg_id"), at_ns)
            return False
        self.ack(sent.select("msg_id"), at_ns)
        return True

    def ack(self, ids: DataFrame, at_ns: int) -> None:
        """Acknowledge what is pending; an answer to anything else changes nothing (see answers)."""
        self._append("ack", at_ns, _valid(ids, "msg_id"))

    def nack(self, ids: DataFrame, at_ns: int) -> None:
        self._append("nack", at_ns, _valid(ids, "msg_id"))

    def promote(self, ids: DataFrame, at_ns: int) -> None:
        self._append("promote", at_ns, _valid(ids, "msg_id"))

    def requeue_timed_out(self, at_ns: int) -> None:
        """Reject, in the consumers' place, all pending messages whose answer is overdue."""
        self._append("nack", at_ns, self.timed_out(at_ns).select("msg_id"))

    def tick(self, at_ns: int, compact_above: int | None = None) -> None:
        """One turn of the scheduler. What is due is ready, and what has expired is gone, by the time alone; then overdue
        deliveries go back to their queues, and a log of more than compact_above bytes is compacted."""
        self.requeue_timed_out(at_ns)
        if compact_above is not None and self.storage_size() > compact_above:
            self.checkpoint(at_ns)

    def purge(self, queue: str, at_ns: int) -> None:
        self._one("purge", at_ns, queue=queue)

    def purge_dead_letters(self, queue: str, at_ns: int) -> None:
        self._one("purge_dead", at_ns, queue=queue)

    def declare_exchange(self, exchange: str, exchange_type: str, at_ns: int) -> None:
        self._one("declare", at_ns, exchange=exchange, exchange_type=exchange_type)

    def delete_exchange(self, exchange: str, at_ns: int) -> None:
        if not exchange:
            raise ValueError("the default exchange can't be deleted")
        self._one("delete", at_ns, exchange=exchange)

    def bind(self, exchange: str, queue: str, binding_key: str, at_ns: int, headers: dict[str, str] | None = None, match_all: bool = True) -> None:
        self._one("bind", at_ns, exchange=exchange, queue=queue, binding_key=binding_key, headers=headers or {}, match_all=match_all)

    def unbind(self, exchange: str, queue: str, binding_key: str, at_ns: int) -> None:
        self._one("unbind", at_ns, exchange=exchange, queue=queue, binding_key=binding_key)

    def subscribe(self, topic: str, subscriber: str, at_ns: int) -> None:
        self._one("subscribe", at_ns, queue=topic, subscriber=subscriber)

    def unsubscribe(self, topic: str, subscriber: str, at_ns: int) -> None:
        self._one("unsubscribe", at_ns, queue=topic, subscriber=subscriber)

    # asking

    def _log(self, as_of: int) -> DataFrame:
        """The commands up to an instant, with `counts`: an acknowledgement or rejection counts only when the message's
        last delivery hasn't been answered before."""
        log = self.commands().where(F.col("at_ns") <= as_of)
        step = F.col("op").isin("deliver", "ack", "nack") & F.col("msg_id").isNotNull()
        along = Window.partitionBy("msg_id").orderBy("batch", "place").rowsBetween(Window.unboundedPreceding, -1)
        before = F.last("op").over(along)
        answers = log.where(step).withColumn("counts", F.when(F.col("op") == "deliver", F.lit(True)).otherwise(F.coalesce(before == "deliver", F.lit(False))))
        return answers.unionByName(log.where(~step).withColumn("counts", F.lit(True)))

    def answers(self, as_of: int) -> DataFrame:
        """(msg_id, op, at_ns, accepted) of every acknowledgement and rejection; those not accepted met nothing pending."""
        return self._log(as_of).where(F.col("op").isin("ack", "nack")).select("msg_id", "op", "at_ns", F.col("counts").alias("accepted"))

    def states(self, as_of: int) -> DataFrame:
        """One row per message: queue, msg_id, payload, headers, priority, lvl, seq, retry, deliveries, due_ns, expires_ns, delivered_ns, state.

        A purge takes what waits in the queue at that time: messages that nothing
        happened to since. Answers count only for what is pending. Commands meet their
        message's others by one shuffle.
        """
        log = self._log(as_of).where("counts")
        order = F.struct("batch", "place")
        when = lambda *ops: F.col("op").isin(*ops)
        body = F.struct("batch", "place", "queue", "payload", "headers", "priority", "retry", "at_ns", "delay_ns", "ttl_ns")
        folded = (
            log.where(when("publish", "deliver", "ack", "nack", "promote") & F.col("msg_id").isNotNull())
            .groupBy("msg_id")
            .agg(
                F.min_by(F.when(when("publish"), body), F.when(when("publish"), order)).alias("m"),
                F.count_if(when("nack")).alias("nacks"), F.count_if(when("deliver")).alias("deliveries"), F.max(when("ack")).alias("acked"),
                F.max(when("promote")).alias("promoted"), F.max(F.when(when("deliver"), F.struct("batch", "place", "at_ns"))).alias("delivered"),
                F.max(F.when(when("nack", "ack"), order)).alias("answered"), F.max(order).alias("last"),
            )
            .where(F.col("m").isNotNull())
        )
        purges = log.where(when("purge", "purge_dead")).groupBy("queue").agg(F.max(F.when(when("purge"), order)).alias("purged"), F.max(F.when(when("purge_dead"), order)).alias("purged_dead"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        row = folded.select(
            F.col("m.queue").alias("queue"), "msg_id", "m.payload", "m.headers", zero("m.priority").alias("priority"), clamp_priority(zero("m.priority")).alias("lvl"),
            (F.col("m.batch") * F.lit(1 << 36) + F.col("m.place")).alias("seq"), (zero("m.retry") + F.col("nacks")).cast("int").alias("retry"), "deliveries",
            F.when(zero("m.delay_ns") > 0, F.col("m.at_ns") + F.col("m.delay_ns")).otherwise(0).alias("due_ns"),
            F.when(zero("m.ttl_ns") > 0, F.col("m.at_ns") + F.col("m.ttl_ns")).otherwise(0).alias("expires_ns"),
            F.col("delivered.at_ns").alias("delivered_ns"), "acked", "promoted", F.struct("delivered.batch", "delivered.place").alias("sent"), "answered", "last",
        )
        dead = F.col("retry") > self.max_retry
        pending = F.col("delivered_ns").isNotNull() & (F.col("answered").isNull() | (F.col("sent") > F.col("answered")))
        expired = (F.col("expires_ns") > 0) & (F.lit(as_of) > F.col("expires_ns"))
        delayed = (F.col("due_ns") > as_of) & ~F.col("promoted")
        state = (
            F.when(F.col("acked"), "acked").when(dead & (F.col("last") < F.col("purged_dead")), "purged").when(dead, "dead").when(pending & ~expired, "pending")
            .when(expired, "expired").when(delayed, "delayed").when(F.col("last") < F.col("purged"), "purged").otherwise("ready")
        )
        return row.join(purges, "queue", "left").withColumn("state", state).drop("acked", "promoted", "sent", "answered", "last", "purged", "purged_dead")

    def _in(self, as_of: int, state: str) -> DataFrame:
        return self.states(as_of).where(F.col("state") == state)

    def ready(self, as_of: int) -> DataFrame:
        return self._in(as_of, "ready")

    def next_messages(self, as_of: int) -> DataFrame:
        """(queue, msg_id): what each queue delivers next."""
        return self.ready(as_of).groupBy("queue").agg(F.min_by("msg_id", queue_order(F.col("lvl"), F.col("seq"))).alias("msg_id"))

    def pending(self, as_of: int) -> DataFrame:
        return self._in(as_of, "pending")

    def timed_out(self, as_of: int) -> DataFrame:
        return self.pending(as_of).where(F.lit(as_of) > F.col("delivered_ns") + self.ack_timeout_ns)

    def delayed(self, as_of: int) -> DataFrame:
        return self._in(as_of, "delayed")

    def dead_letters(self, as_of: int) -> DataFrame:
        return self._in(as_of, "dead").withColumn("queue", dead_letter_name(F.col("queue")))

    def has_messages(self, ids: DataFrame, as_of: int) -> DataFrame:
        """The ids that some queue, consumer or the delay still holds."""
        held = self.states(as_of).where(F.col("state").isin("ready", "pending", "delayed")).select("msg_id")
        return ids.join(held, "msg_id", "left_semi")

    def exchanges(self) -> DataFrame:
        """(exchange, exchange_type) declared since their last deletion; the first type stays."""
        own = self.commands().where(F.col("op").isin("declare", "delete"))
        gone = own.groupBy("exchange").agg(F.max(F.when(F.col("op") == "delete", F.struct("batch", "place"))).alias("gone"))
        live = own.where(F.col("op") == "declare").join(gone, "exchange").where(F.col("gone").isNull() | (F.struct("batch", "place") > F.col("gone")))
        return live.groupBy("exchange").agg(F.min_by("exchange_type", F.struct("batch", "place")).alias("exchange_type"))

    def bindings(self) -> DataFrame:
        """(exchange, queue, binding_key, headers, match_all) bound since the exchange's deletion; the last unbind of a queue and key ends all before it."""
        log = self.commands()
        order = F.struct("batch", "place")
        gone = log.where(F.col("op") == "delete").groupBy("exchange").agg(F.max(order).alias("gone"))
        ends = log.where(F.col("op") == "unbind").groupBy("exchange", "queue", "binding_key").agg(F.max(order).alias("ended"))
        live = log.where(F.col("op") == "bind").join(gone, "exchange", "left").join(ends, ["exchange", "queue", "binding_key"], "left")
        since = lambda c: F.col(c).isNull() | (order > F.col(c))
        return live.where(since("gone") & since("ended")).select("exchange", "queue", "binding_key", "headers", "match_all")

    def subscribers(self) -> DataFrame:
        """(queue, subscriber, since): subscribed by their last command."""
        own = self.commands().where(F.col("op").isin("subscribe", "unsubscribe"))
        last = own.groupBy("queue", "subscriber").agg(F.max(F.struct("batch", "place", "op")).alias("c"))
        return last.where(F.col("c.op") == "subscribe").select("queue", "subscriber", F.struct("c.batch", "c.place").alias("since"))

    def inbox(self) -> DataFrame:
        """(queue, subscriber, msg_id, payload): what was published to each subscriber's topic since it subscribed."""
        sent = self.commands().where(F.col("op") == "publish_topic").select("queue", "msg_id", "payload", F.struct("batch", "place").alias("at"))
        return join_salted(sent, self.subscribers(), "queue", "msg_id").where(F.col("at") > F.col("since")).select("queue", "subscriber", "msg_id", "payload")

    def stats(self, as_of: int) -> DataFrame:
        """(kind, name, n): depth per queue and dead-letter queue, subscribers per topic, messages per state."""
        s = self.states(as_of)
        count = lambda df, name: df.groupBy(name.alias("name")).agg(F.count("*").alias("n"))
        return long_format([
            ("queue", count(s.where(F.col("state") == "ready"), F.col("queue"))),
            ("dead_letter", count(s.where(F.col("state") == "dead"), dead_letter_name(F.col("queue")))),
            ("topic", count(self.subscribers(), F.col("queue"))),
            ("state", count(s, F.col("state"))),
        ])

    # storage

    def storage_size(self) -> int:
        """Bytes of the current version."""
        version = self._version()
        if version < 0:
            return 0
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{version}")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(place).getLength()

    def checkpoint(self, as_of: int) -> None:
        """Write a new version with only what the state at as_of and later depends on: commands of messages that
        aren't acknowledged, expired or purged, and those about exchanges and subscriptions. The new version counts
        once it is complete; the old one is left to be deleted."""
        log = self.commands()
        over = self.states(as_of).where(F.col("state").isin("acked", "expired", "purged")).select("msg_id")
        about_messages = F.col("op").isin("publish", "deliver", "ack", "nack", "promote")
        kept = log.where(about_messages).join(over, "msg_id", "left_anti").select(*_COLUMNS).unionByName(log.where(~about_messages).select(*_COLUMNS))
        kept.write.mode("overwrite").parquet(f"{self.path}/v{self._version() + 1}/n0")


def _valid(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows whose named columns aren't empty."""
    for c in columns:
        rows = rows.where(F.coalesce(F.col(c), F.lit("")) != "")
    return rows


def _literal(value: object) -> Column:
    if isinstance(value, dict):
        return F.create_map(*[F.lit(x) for kv in value.items() for x in kv]) if value else F.lit(None).cast("map<string,string>")
    return F.lit(value)
