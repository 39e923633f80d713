"""The live broker's dataflows as streams over arriving files.

Each returns a streaming DataFrame; run_to_end (see dedup) drains what is there,
writeStream with a processing-time trigger keeps it going.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tallylog.operators.routing import route
from tallylog.sources.tables import table_path
from tallylog.streaming.dedup import stream_place


def arriving(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table's file or folder as a stream."""
    path = table_path(folder, name)
    place, file = stream_place(spark, path)
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    return source.option("pathGlobFilter", file or "*").parquet(place)


def keep_running(stream: DataFrame, out: str, checkpoint: str, every: str = "1 second", mode: str = "append") -> StreamingQuery:
    """Start a stream that looks for new input once per tick; started again with the same folders it goes on where it stopped."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(processingTime=every).start()


def rates(stream: DataFrame, at: str, kind: str, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n) per window, once the watermark has passed its end."""
    return (
        stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, every), kind).agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("start"), kind, "n")
    )


def fan_out(stream: DataFrame, bindings: DataFrame, kind: str) -> DataFrame:
    """Arriving messages, one row per queue; few bindings are compiled into the stream's plan, many joined as a table."""
    return route(stream, bindings, kind)


class Lifecycle(StatefulProcessor):
    """One message's (or key's) way: publish makes it ready, ack ends it, nack or a timeout retries it or ends it as dead.

    Rows: seq, op ('publish', 'ack', 'nack'), at_ms. Commands may come late and
    repeatedly: those that the watermark hasn't passed wait in the store, each seq
    once, and are folded in order of seq with what came before them; only what it
    has passed is folded for good. Emits the state after each batch and timer, that
    of the waiting commands included. With a timeout, an event-time timer stands for
    the missing answer of each delivery.
    """

    def __init__(self, max_retry: int, timeout_ms: int | None = None):
        self.max_retry, self.timeout_ms = max_retry, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "state string, retry int, seq bigint, at_ms bigint")
        self.waiting = handle.getValueState("waiting", "seqs array<bigint>, ops array<string>, ats array<bigint>")

    def _fold(self, start: tuple, seq: np.ndarray, op: np.ndarray, at: np.ndarray) -> tuple:
        """(state, retry, seq, at_ms) after commands in order of seq: what follows the last publish decides."""
        if not len(seq):
            return start
        state, retry = start[:2]
        publishes = np.flatnonzero(op == "publish")
        if len(publishes):
            state, retry = "ready", 0
            op = op[publishes[-1] + 1 :]
        if state == "ready":
            acks = np.flatnonzero(op == "ack")
            nacks = int((op[: acks[0]] if len(acks) else op).tolist().count("nack"))
            if retry + nacks > self.max_retry:
                state, retry = "dead", self.max_retry + 1
            else:
                state, retry = ("acked" if len(acks) else "ready"), retry + nacks
        return state, retry, int(seq[-1]), int(at[-1])

    def _known(self, new: pd.DataFrame | None) -> tuple[tuple, np.ndarray, np.ndarray, np.ndarray]:
        """What is settled, and the waiting commands with the new ones, each seq once and in order."""
        settled = self.settled.get() if self.settled.exists() else ("none", 0, -1, 0)
        seqs, ops, ats = self.waiting.get() if self.waiting.exists() else ([], [], [])
        seq, op, at = np.array(seqs, dtype=np.int64), np.array(ops, dtype=object), np.array(ats, dtype=np.int64)
        if new is not None:
            seq = np.concatenate([seq, new["seq"].to_numpy(dtype=np.int64)])
            op = np.concatenate([op, new["op"].to_numpy(dtype=object)])
            at = np.concatenate([at, new["at_ms"].to_numpy(dtype=np.int64)])
        _, first = np.unique(seq, return_index=True)
        first = first[seq[first] > settled[2]]
        return settled, seq[first], op[first], at[first]

    def _keep(self, settled: tuple, seq: np.ndarray, op: np.ndarray, at: np.ndarray, watermark: int) -> None:
        """Fold for good what no later command can come before, and let the rest wait."""
        later = np.flatnonzero(at >= watermark)
        n = int(later[0]) if len(later) else len(seq)
        self.settled.update(tuple(self._fold(settled, seq[:n], op[:n], at[:n])))
        self.waiting.update((seq[n:].tolist(), op[n:].tolist(), at[n:].tolist()))

    def _row(self, key, now: tuple) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "seq": [now[2]], "state": [now[0]], "retry": [now[1]]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self._known(pd.concat(list(rows)))
        now = self._fold(*known)
        self._keep(*known, timerValues.getCurrentWatermarkInMs())
        if self.timeout_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if now[0] == "ready":
                self.handle.registerTimer(now[3] + self.timeout_ms)
        yield self._row(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        settled, seq, op, at = self._known(None)
        due = expiredTimerInfo.getExpiryTimeInMs()
        n = int((at < due).sum())
        now = self._fold(settled, seq[:n], op[:n], at[:n])
        if now[0] == "ready":
            retry = now[1] + 1
            now = ("dead" if retry > self.max_retry else "ready", retry, now[2], due)
            if now[0] == "ready":
                self.handle.registerTimer(due + self.timeout_ms)
        self.settled.update(tuple(now))
        self.waiting.update((seq[n:].tolist(), op[n:].tolist(), at[n:].tolist()))
        yield self._row(key, self._fold(now, seq[n:], op[n:], at[n:]))

    def close(self) -> None:
        pass


def lifecycles(commands: DataFrame, max_retry: int, timeout_ms: int | None = None, late: str = "1 minute") -> DataFrame:
    """(key, seq, state, retry) updates of every key of a stream (key, seq, op, at_ms, at); at, the time at_ms, may be up to `late` behind."""
    return commands.withWatermark("at", late).groupBy("key").transformWithStateInPandas(
        statefulProcessor=Lifecycle(max_retry, timeout_ms), outputStructType="key bigint, seq bigint, state string, retry int", outputMode="Update", timeMode="EventTime",
    )


# the processor also runs beside the driver, in a process that knows no shipped code
cloudpickle.register_pickle_by_value(sys.modules[__name__])
