"""Rebuilding the current state from a feed of inserts, updates and deletes.

The state is a signed multiset of images (feed, msg_id, pos). Every change adds
its after-image with multiplicity +1 and takes away its before-image with -1; the
images whose multiplicities sum with those of the base to more than nothing are
the current state. Changes are deduplicated first, so arriving repeatedly or out
of order makes no difference.

A change's before-image is what the changes before it left: running state per
message, by windows for ordinary messages and by split ranges for busy ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce as reduce_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylog.functions.ids import canonical_id
from tallylog.operators.ranges import busy_keys, range_bounds, ranges_for, running, running_before, windowed
from tallylog.session import materialized, parallelism

#: Record types of the write-ahead log.
WAL_PUBLISH, WAL_ACK = 1, 2
#: Command types of the replicated log that change messages.
RAFT_PUBLISH, RAFT_ACK, RAFT_UPDATE, RAFT_PURGE = 1, 2, 3, 7

_FOREVER = 9223372036854775807


def sum_images(images: DataFrame, keys: list[str], sign: str = "sign") -> DataFrame:
    """Rows of keys whose signs sum to more than 0, once each.

    The sum is combined before the shuffle, so images that cancel within a
    partition (nearly all of a busy key's) never leave it.
    """
    return images.groupBy(*keys).agg(F.sum(sign).alias("__n")).where(F.col("__n") > 0).drop("__n")


def _by_share(df: DataFrame, keys: list[str], busy: list) -> list[tuple[DataFrame, Callable]]:
    """df in parts with the way their running state is made: ordinary keys by windows, busy ones by split ranges.

    df is read several times if there are busy keys, and so is each step of theirs,
    which is therefore written.
    """
    if not busy:
        return [(df, windowed)]
    hit = F.col(keys[-1]).isin(busy)
    own = df.where(hit)
    rows = own.count()
    bounds = range_bounds(own, keys, "pos", ranges_for(df.sparkSession, rows), rows=rows)

    def split(part, keys, order, values, inclusive):
        return materialized(running(part, keys, order, values, inclusive, bounds=bounds), "running")

    return [(df.where(~hit), windowed), (own, split)]


def apply_changes(base: DataFrame, changes: DataFrame, feed: str, key: str, pos: str, kind: str, put: int, remove: int) -> DataFrame:
    """(feed, key, pos) of every record live after the changes.

    base: live images (feed, key, pos) before the first change; may be empty.
    changes: kind = put inserts or replaces key at pos, kind = remove removes it,
    any other kind changes nothing. Changes with a null feed, key or pos change
    nothing. The same (feed, pos) is one change however often it comes; were its
    copies to differ, the smallest (kind, key) counts. Positions lie below 2^62. A key may hold any share
    of all changes (see running_before). Other columns are ignored.
    """
    raw = changes.where(F.col(kind).isin(put, remove) & F.col(key).isNotNull())
    busy = busy_keys(raw, key, changes.count(), parallelism(changes.sparkSession))
    one = (
        raw.select(F.col(feed).alias("feed"), F.col(pos).cast("long").alias("pos"), F.struct(F.col(kind).alias("kind"), F.col(key).alias("key")).alias("c"))
        .where(F.col("feed").isNotNull() & F.col("pos").isNotNull())
        .groupBy("feed", "pos")
        .agg(F.min("c").alias("c"))
        .select("feed", "pos", "c.key", (F.col("c.kind") == put).alias("puts"))
    )
    log = one.unionByName(base.select(F.col(feed).alias("feed"), F.col(pos).cast("long").alias("pos"), F.col(key).alias("key"), F.lit(True).alias("puts")))
    if busy:
        log = materialized(log, "changes")  # read several times below
    # the change before, as one number: its position and, in the lowest bit, whether it puts
    code = F.col("pos") * 2 + F.col("puts").cast("long")
    after_image = F.when(F.col("puts"), F.col("pos"))
    before_image = F.when(F.col("prev").bitwiseAND(F.lit(1)) == 1, F.shiftright("prev", 1))
    before = _union(seen(part, ["feed", "key"], "pos", {"prev": ("max", code)}, False) for part, seen in _by_share(log, ["feed", "key"], busy))
    images = before.select("feed", "key", F.stack(F.lit(2), after_image, F.lit(1), before_image, F.lit(-1)).alias("pos", "sign")).where(F.col("pos").isNotNull())
    return sum_images(images, ["feed", "key", "pos"]).select(F.col("feed").alias(feed), F.col("key").alias(key), F.col("pos").alias(pos))


def wal_live(wal: DataFrame) -> DataFrame:
    """(feed, msg_id, pos): per node the messages whose last record is a publish.

    Records without an id, of other types, without node or lsn change nothing.
    An empty log gives no rows.
    """
    log = wal.select(
        F.col("node_id").alias("feed"), F.col("lsn").alias("pos"), F.col("rec_type").alias("kind"), canonical_id("msg_id").alias("msg_id")
    )
    return apply_changes(log.limit(0), log, "feed", "msg_id", "pos", "kind", WAL_PUBLISH, WAL_ACK)


# the replicated log


def committed(raft: DataFrame) -> DataFrame:
    """One entry per log_index: that of the highest term (null is lowest), once."""
    return (
        raft.where(F.col("log_index").isNotNull())
        .groupBy("log_index")
        .agg(F.max(F.struct("term", "cmd_type", canonical_id("message_id").alias("msg_id"), "topic")).alias("c"))
        .select(F.col("log_index").alias("pos"), "c.cmd_type", "c.msg_id", "c.topic")
    )


_END = 0  # kind of the steps that purges make


def _events(log: DataFrame, base: DataFrame | None) -> DataFrame:
    """(msg_id, pos, kind, until) of the commands about messages; until is, for inserts, the next purge of their topic.

    Which purge comes next is running state along the topic, so a busy topic is cut.
    """
    msg = F.col("msg_id").isNotNull()
    inserts = log.where((F.col("cmd_type") == RAFT_PUBLISH) & msg).select("msg_id", "topic", "pos")
    if base is not None:
        inserts = inserts.unionByName(base.select("msg_id", "topic", "pos"))
    purges = log.where((F.col("cmd_type") == RAFT_PURGE) & F.col("topic").isNotNull()).select(F.lit(None).cast("string").alias("msg_id"), "topic", "pos")
    shape = lambda df, kind, until: df.select("msg_id", "pos", F.lit(kind).alias("kind"), until.alias("until"))
    forever = F.lit(_FOREVER)
    own = log.where(F.col("cmd_type").isin(RAFT_ACK, RAFT_UPDATE) & msg)
    others = own.select("msg_id", "pos", F.col("cmd_type").alias("kind"), forever.alias("until"))
    if purges.isEmpty():
        return others.unionByName(shape(inserts, RAFT_PUBLISH, forever))
    by_topic = inserts.where(F.col("topic").isNotNull()).unionByName(purges).withColumn("back", -F.col("pos"))
    rows = log.count() + (base.count() if base is not None else 0)
    purged = running_before(by_topic, ["topic"], "back", F.when(F.col("msg_id").isNull(), F.col("back")), "purge_back", rows=rows)
    ended = shape(purged.where(msg), RAFT_PUBLISH, F.coalesce(-F.col("purge_back"), forever))
    return others.unionByName(ended).unionByName(shape(inserts.where(F.col("topic").isNull()), RAFT_PUBLISH, forever))


def _begin(events: DataFrame, seen: Callable) -> DataFrame:
    """events with `begins`: inserts before which the message is dead for certain, since every earlier insert's
    purge, or an acknowledgement, has come by then. With one topic per message these are all that begin a life."""
    acked = seen(events, ["msg_id"], "pos", {"acked": ("max", F.when(F.col("kind") == RAFT_ACK, F.col("pos")))}, False)
    acked = acked.withColumn("acked", F.coalesce("acked", F.lit(-1)))
    put = F.col("kind") == RAFT_PUBLISH
    held = seen(acked, ["msg_id"], "pos", {"held": ("max", F.when(put, F.struct("acked", "until")))}, False)
    free = F.col("held").isNull() | (F.col("held.acked") < F.col("acked")) | (F.col("held.until") < F.col("pos"))
    return held.select("msg_id", "pos", "kind", "until", (put & free).alias("begins"))


def _effects(begun: DataFrame, seen: Callable) -> DataFrame:
    """(msg_id, pos, kind, begins, live, before, start, open) of each event and of the ends that purges make.

    live: the message is live before it, and, at a purge's end, by the insert that
    this purge ends; before: the position of its image then. open: an insert that
    may begin a life after a purge though it isn't certain (see _chains).
    """
    end = F.when(F.col("begins") & (F.col("until") < _FOREVER), F.struct(F.col("until").alias("pos"), F.lit(_END).alias("kind"), F.lit(False).alias("begins"), F.col("until"), F.col("pos").alias("begun")))
    own = F.struct("pos", "kind", "begins", "until", F.lit(None).cast("long").alias("begun"))
    steps = begun.select("msg_id", F.inline(F.array_compact(F.array(own, end))))
    at = lambda test: F.when(test, F.col("pos"))
    known = seen(
        steps, ["msg_id"], "pos",
        {
            "life": ("max", F.when(F.col("begins"), F.struct("pos", "until"))), "updated": ("max", at(F.col("kind") == RAFT_UPDATE)),
            "gone": ("max", at(F.col("kind") == RAFT_ACK)),
        },
        False,
    )
    alive = F.coalesce((F.col("life.pos") > F.coalesce("gone", F.lit(-1))) & (F.col("life.until") >= F.col("pos")), F.lit(False))
    mine = F.col("begun").isNull() | (F.col("begun") == F.col("life.pos"))
    open_ = (F.col("kind") == RAFT_PUBLISH) & ~F.col("begins") & (F.col("life.until") < F.col("pos"))
    start = F.when(F.col("begins"), F.col("pos")).otherwise(F.col("life.pos"))
    return known.select(
        "msg_id", "pos", "kind", "begins", (alive & mine).alias("live"), F.greatest("life.pos", "updated").alias("before"), start.alias("start"),
        F.coalesce(open_, F.lit(False)).alias("open"),
    )


def _chains(begun: DataFrame, seen: Callable) -> DataFrame:
    """begun with the lives that begin after others of the same message ended by a purge.

    From a certain beginning each life leads to the next: the first insert after its
    purge. Which inserts such a chain meets is found by doubling its steps, in as
    many joins as the logarithm of its length; they join on message and position, of
    which each occurs once, so no join is skewed.
    """
    last = seen(begun, ["msg_id"], "pos", {"life": ("max", F.when(F.col("begins"), F.struct("pos", "until")))}, True)
    # inserts before the purge of the certain beginning before them are blocked
    mayhap = F.col("begins") | (F.col("life.until") < F.col("pos"))
    nodes = materialized(last.where((F.col("kind") == RAFT_PUBLISH) & mayhap).select("msg_id", F.col("life.pos").alias("block"), "pos", "until", "begins"), "nodes")
    asked = nodes.where(F.col("until") < _FOREVER).select("msg_id", "block", F.col("until").alias("at"), "pos", F.lit(None).cast("long").alias("node"))
    both = asked.unionByName(nodes.select("msg_id", "block", F.col("pos").alias("at"), F.lit(None).cast("long").alias("pos"), F.col("pos").alias("node")))
    found = running(both.withColumn("back", -F.col("at")), ["msg_id", "block"], "back", {"next": ("min", F.col("node"))}, inclusive=False)
    hop = materialized(found.where(F.col("pos").isNotNull() & F.col("next").isNotNull()).select("msg_id", "pos", "next"), "hops")
    reached = nodes.where("begins").select("msg_id", "pos")
    while True:
        new = materialized(reached.join(hop, ["msg_id", "pos"]).select("msg_id", F.col("next").alias("pos")), "reached")
        if new.isEmpty():
            break
        reached = reached.unionByName(new)
        far = hop.select("msg_id", F.col("pos").alias("next"), F.col("next").alias("far"))
        hop = materialized(hop.join(far, ["msg_id", "next"]).select("msg_id", "pos", F.col("far").alias("next")), "hops")
    begin = reached.withColumn("__met", F.lit(True))
    met = F.coalesce("__met", F.lit(False)) & (F.col("kind") == RAFT_PUBLISH)
    return begun.join(begin, ["msg_id", "pos"], "left").select("msg_id", "pos", "kind", "until", met.alias("begins"))


def _resolve(log: DataFrame, base: DataFrame | None, reduce: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """reduce(effects of all events); reduce keeps msg_id, and the rows that are open with their mark.

    Messages with open inserts are done again with all their chains; as a rule there are none.
    """
    spark = log.sparkSession
    events = materialized(_events(log, base), "message-events")
    parts = _by_share(events, ["msg_id"], busy_keys(events, "msg_id", events.count(), parallelism(spark)))
    done = materialized(_union(reduce(_effects(_begin(part, seen), seen)) for part, seen in parts), "steps")
    opened = done.where("open").select("msg_id").distinct()
    if opened.isEmpty():
        return done.drop("open")
    again = materialized(events.join(opened, "msg_id", "left_semi"), "message-events")
    slow = []
    for part, seen in _by_share(again, ["msg_id"], busy_keys(again, "msg_id", again.count(), parallelism(spark))):
        begun = materialized(_begin(part, seen), "begun")
        slow.append(reduce(_effects(_chains(begun, seen), seen)))
    return done.join(opened, "msg_id", "left_anti").unionByName(_union(slow)).drop("open")


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce_(DataFrame.unionByName, parts)


def message_steps(raft: DataFrame) -> DataFrame:
    """(msg_id, pos, kind, begins, live, before, start): what each command about messages found.

    kind is the command's type, or 0 for the end that a purge makes of a life, at
    the purge's position. begins: an insert that took effect. live: an update,
    acknowledgement or purge that took effect on the life begun at `start`; before
    is the image it found.
    """
    return _resolve(materialized(committed(raft), "committed"), None, lambda steps: steps)


def _images(steps: DataFrame) -> DataFrame:
    """(msg_id, pos, start, n, open): the multiplicities of the images that the steps add and take away."""
    image = lambda pos, n: F.struct(pos.alias("pos"), F.lit(n).alias("sign"), F.col("open"))
    live, at = F.col("live"), F.col("pos")
    each = F.array(
        F.when(F.col("begins") | (live & (F.col("kind") == RAFT_UPDATE)), image(at, 1)),
        F.when(live & F.col("kind").isin(RAFT_UPDATE, RAFT_ACK, _END), image(F.col("before"), -1)),
        F.when(F.col("open"), image(at, 0)),
    )
    flat = steps.select("msg_id", "start", F.inline(F.array_compact(each)))
    return flat.groupBy("msg_id", "pos", "start").agg(F.sum("sign").alias("n"), F.max("open").alias("open")).where((F.col("n") > 0) | F.col("open"))


def raft_state(raft: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """(msg_id, topic, pos) of the messages live after a replicated log's commands.

    Publish inserts unless the message is live, update changes a live one,
    acknowledge removes it, purge removes all that were inserted with its topic.
    base: the state before the first command, of which every message's image has
    the multiplicity 1 already; its positions are smaller than any command's.

    1. Each insert learns the next purge of its topic.
    2. Inserts before which the message is dead begin lives (_begin, _chains).
    3. Each command adds its after-image and takes away its before-image, which is
       the life's last; a purge does so in every message that it ends.
    4. The images' multiplicities are summed with the base's.
    """
    log = materialized(committed(raft), "committed")
    live = _resolve(log, base, _images).select("msg_id", "pos", "start")
    begun = log.where(F.col("cmd_type") == RAFT_PUBLISH).select("msg_id", F.col("pos").alias("start"), "topic")
    if base is not None:
        begun = begun.unionByName(base.select("msg_id", F.col("pos").alias("start"), "topic"))
    return live.join(begun, ["msg_id", "start"]).select("msg_id", "topic", "pos")


def raft_live(raft: DataFrame) -> DataFrame:
    """(feed, msg_id, pos) of the messages live at the end of the replicated log (see raft_state); feed is 'raft'."""
    live = _resolve(materialized(committed(raft), "committed"), None, _images)
    return live.select(F.lit("raft").alias("feed"), "msg_id", "pos")


def live_messages(wal: DataFrame, raft: DataFrame) -> DataFrame:
    """Both logs' live messages (feed, msg_id, pos)."""
    return wal_live(wal).unionByName(raft_live(raft))
