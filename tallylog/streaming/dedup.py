"""Exactly one copy of each message that was delivered at least once.

A stream keeps, in Spark's keyed state store (RocksDB), the identifiers seen lately
with their best copy. Of every arriving batch it decides at once: a copy that loses
to another is superfluous for good, the winner leads. An identifier leaves the store
when the event-time watermark has passed its last sighting, so the store holds a
period's identifiers; a Bloom filter of those that left stays. The store's
checkpoint and the sink's log commit together, micro-batch by micro-batch.

Late-arrival lookup: a row that comes behind the watermark, or whose identifier may
have left the store, begins a second visit of its identifier. Only these identifiers
are looked up in the leads written so far, and the best of their visits stays.

The store is divided into shards of identifiers, a group of the stream each, so one
call handles a shard's batch with vector operations instead of one row or key.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.functions.ids import canonical_id
from tallylog.operators.ranges import busy_keys
from tallylog.session import folder_size, fresh_dir, parallelism, ship

#: How long an identifier is kept in the store after its event time.
WATERMARK = "1 day"
#: A table is read in at least BATCHES micro-batches, of at most BYTES_PER_BATCH each
#: (files aren't split); parameters of throughput, not of results.
BATCHES, BYTES_PER_BATCH = 4, 16 << 30
#: Shards per task, and the bytes of a micro-batch that a shard takes at most.
SHARDS_PER_TASK, BYTES_PER_SHARD = 4, 64 << 20

_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}

#: Below every counter; stands for null.
_NONE = -(1 << 40)
_LEAD, _OUT = 0, 1
_DECISIONS = "msg_id string, row_id bigint, a bigint, b bigint, look boolean, led boolean"
_HELD = ["msg_id", "row_id", "a", "b", "ms", "h"]


def first_sightings(arrivals: DataFrame, keys: list[str], event_time: str, watermark: str = WATERMARK) -> DataFrame:
    """A stream's rows without those whose keys are in the store of keys seen within the watermark."""
    return arrivals.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(keys)


def run_to_end(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", each=None, partition_by: str | None = None) -> None:
    """Process all that has arrived, then stop; a later call with the same folders goes on from there.

    each: a function (batch, number) that writes a batch instead of the file sink;
    it must give the same result when a batch is repeated.
    """
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in _STORE}
    try:
        for k, v in _STORE.items():
            spark.conf.set(k, v)
        writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
        if each:
            writer = writer.foreachBatch(each)
        else:
            writer = writer.format("parquet").option("path", out)
            writer = writer.partitionBy(partition_by) if partition_by else writer
        writer.start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_place(spark: SparkSession, path: str) -> tuple[str, str | None]:
    """The folder to stream from, and the file's name if path is a single file (a file source reads folders)."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        return str(where.getParent()), where.getName()
    return path, None


class Left:
    """A Bloom filter that grows: the hashes of identifiers that left a shard's store (about 1 in 2000 false hits a layer)."""

    BITS, HASHES, FIRST = 16, 7, 4096

    def __init__(self) -> None:
        self.layers: list[tuple[np.ndarray, int]] = []  # bits, hashes in it

    def _places(self, h: np.ndarray, size: int) -> np.ndarray:
        low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        steps = np.arange(self.HASHES, dtype=np.uint64)[:, None]
        return (low[None, :] + steps * high[None, :]) % np.uint64(size * 8)

    def add(self, h: np.ndarray) -> None:
        while len(h):
            if not self.layers or self.layers[-1][1] * self.BITS >= self.layers[-1][0].size * 8:
                hold = self.FIRST << len(self.layers)
                self.layers.append((np.zeros(hold * self.BITS // 8, dtype=np.uint8), 0))
            bits, n = self.layers[-1]
            room = bits.size * 8 // self.BITS - n
            at = self._places(h[:room], bits.size)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, at & np.uint64(7)).astype(np.uint8))
            self.layers[-1] = (bits, n + len(h[:room]))
            h = h[room:]

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.zeros(len(h), dtype=bool)
        for bits, _ in self.layers:
            at = self._places(h, bits.size)
            found |= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=0)
        return found


def settle(new: pd.DataFrame, held: pd.DataFrame, left: Left, now: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(decisions, what the store holds next) of one shard's batch; `left` grows by what leaves the store.

    new: msg_id, row_id, a, b, ms (event time, null if unknown), h (hash of msg_id),
    busy (its copies lie in several shards). held: the store's leads. now: the
    watermark in ms.
    """
    rows = pd.concat([held.assign(busy=False, old=True), new.assign(old=False)], ignore_index=True)
    code, ids = pd.factorize(rows["msg_id"])
    known = np.zeros(len(ids), dtype=bool)
    known[code[rows["old"].to_numpy(dtype=bool)]] = True
    timely = (rows["ms"] >= now).to_numpy()
    old, busy = rows["old"].to_numpy(dtype=bool), rows["busy"].to_numpy(dtype=bool)
    # a visit that the store knows, or that a timely row begins, goes on in the store; late rows alone are one of their own
    stored = known.copy()
    stored[code[timely]] = True
    order = np.lexsort((rows["row_id"].to_numpy(), -rows["b"].to_numpy(), -rows["a"].to_numpy(), code))
    first = np.ones(len(order), dtype=bool)
    first[1:] = code[order][1:] != code[order][:-1]
    lead = np.zeros(len(order), dtype=bool)
    lead[order[first]] = True
    h = rows["h"].to_numpy().astype(np.int64).view(np.uint64)
    look = busy | (~known[code] & (~stored[code] | left.has(h)))
    out = ~lead
    emitted = (lead & ~old) | out
    decisions = pd.DataFrame({
        "out": out[emitted], "msg_id": rows["msg_id"][emitted], "row_id": rows["row_id"][emitted], "a": rows["a"][emitted],
        "b": rows["b"][emitted], "look": look[emitted], "led": (old & out)[emitted],
    })
    latest = np.full(len(ids), np.iinfo(np.int64).min)
    ms = np.where(rows["ms"].notna(), rows["ms"].fillna(0), latest.min() if len(latest) else 0).astype(np.int64)
    np.maximum.at(latest, code, ms)
    keep = rows[lead & stored[code]].assign(ms=latest[code[lead & stored[code]]])
    gone = (keep["ms"] < now).to_numpy()
    left.add(np.concatenate([keep["h"][gone].to_numpy(), rows["h"][lead & ~stored[code]].to_numpy()]).astype(np.int64).view(np.uint64))
    return decisions, keep.loc[~gone, _HELD]


def _settle_shard(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    from tallylog.streaming.dedup import _HELD, Left, settle

    held, left = pickle.loads(state.get[0]) if state.exists else (pd.DataFrame({c: pd.Series(dtype="object" if c == "msg_id" else "int64") for c in _HELD}), Left())
    new = pd.concat(list(frames), ignore_index=True)
    decisions, held = settle(new[[*_HELD, "busy"]], held, left, state.getCurrentWatermarkMs())
    state.update((pickle.dumps((held, left), protocol=5),))
    yield decisions


def superfluous_copies(
    spark: SparkSession, path: str, watermark: str = WATERMARK, files_per_batch: int | None = None, store: str | None = None, batches: int = BATCHES
) -> DataFrame:
    """(msg_id, row_id): each row of a file or folder of messages that has an id and isn't its message's one kept copy.

    Kept is the copy of the highest delivery_count, then retry, then the smallest
    row_id; null is below every number. Ids compare as canonical_id gives them; rows
    without one are neither kept nor superfluous. Rows with a null received_at come
    behind any watermark. Equal copies differ by row_id. An empty folder gives no
    rows. One id may hold any share of the rows: the copies of a busy id are spread
    over as many shards as there are tasks, each of which keeps a lead of its own,
    for the lookup to settle.

    store: a folder in which checkpoint and decisions are kept. A later call with
    the same folder reads only files that are new, with the shards and watermark of
    the first; without one, the call has a folder of its own below the shared one.
    """
    ship(spark)
    table = spark.read.parquet(path)
    folder, name = stream_place(spark, path)
    source = spark.readStream.schema(table.schema)
    if name:
        source = source.option("pathGlobFilter", name)
    size = folder_size(spark, path)
    per_batch = max(1, min(BYTES_PER_BATCH, -(-size // batches)))
    source = source.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else source.option("maxBytesPerTrigger", per_batch)
    work = store.rstrip("/") if store else fresh_dir(spark, "dedup")
    tasks = parallelism(spark)
    shards = _fixed(spark, f"{work}/shards", max(tasks * SHARDS_PER_TASK, per_batch // BYTES_PER_SHARD))
    busy = busy_keys(table.select(canonical_id("id").alias("id")), "id", table.count(), tasks)
    is_busy = F.coalesce(F.col("msg_id").isin(busy), F.lit(False)) if busy else F.lit(False)
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(_NONE))
    arrived = (
        source.parquet(folder)
        .select(canonical_id("id").alias("msg_id"), F.col("row_id").cast("long").alias("row_id"), number("delivery_count").alias("a"), number("retry").alias("b"), "received_at")
        .where(F.col("msg_id").isNotNull() & F.col("row_id").isNotNull())
        .withColumn("h", F.xxhash64("msg_id"))
        .withColumn("busy", is_busy)
        .withColumn("ms", F.unix_millis(F.col("received_at").cast("timestamp")))
        .withColumn("shard", F.pmod(F.when(F.col("busy"), F.xxhash64("msg_id", F.pmod("row_id", F.lit(tasks)))).otherwise(F.col("h")), F.lit(shards)))
        .withWatermark("received_at", watermark)
    )
    decided = arrived.groupBy("shard").applyInPandasWithState(_settle_shard, f"out boolean, {_DECISIONS}", "held binary", "append", "NoTimeout")
    decided = decided.select(*[c.split()[0] for c in _DECISIONS.split(", ")], F.when(F.col("out"), _OUT).otherwise(_LEAD).alias("kind"))
    run_to_end(decided, f"{work}/decisions", f"{work}/checkpoint", partition_by="kind")
    return _superfluous(spark.read.schema(f"{_DECISIONS}, kind int").parquet(f"{work}/decisions"))


def _superfluous(decisions: DataFrame) -> DataFrame:
    """What lost to another copy, and of the ids to be looked up every lead but the best."""
    leads, out = decisions.where(F.col("kind") == _LEAD), decisions.where(F.col("kind") == _OUT)
    asked = leads.where("look").select("msg_id").distinct()
    rank = F.struct("a", "b", (-F.col("row_id")).alias("c"))
    visits = leads.join(asked, "msg_id", "left_semi").select("msg_id", "row_id", rank.alias("rank"))
    best = visits.groupBy("msg_id").agg(F.max("rank").alias("best"))
    beaten = visits.join(best, "msg_id").where(F.col("rank") != F.col("best")).select("msg_id", "row_id")
    # a lead that lost later, in its own visit, is among `out` already
    rest = beaten.join(out.where("led").select("row_id"), "row_id", "left_anti")
    return out.select("msg_id", "row_id").unionByName(rest.select("msg_id", "row_id"))


def _fixed(spark: SparkSession, path: str, value: int) -> int:
    """A number that the first call writes to path and every later one reads."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        spark.createDataFrame([(value,)], "n long").coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).first()[0]
