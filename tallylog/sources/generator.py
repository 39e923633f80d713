"""A made-up publish load of any size, for measuring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.functions.ids import derived_id

#: Fixed values of the load: one message in five is delayed by a minute.
DELAYED_IN, DELAY_NS = 5, 60_000_000_000


def load(spark: SparkSession, n: int, queues: int = 10, start_ns: int = 0, gap_ns: int = 1_000_000) -> DataFrame:
    """n messages (seq, msg_id, topic, ts_ns, delay_ns, priority), made where they are used."""
    seq = F.col("id")
    return spark.range(n).select(
        seq.alias("seq"), derived_id(seq.cast("string")).alias("msg_id"), F.concat(F.lit("queue."), F.pmod(seq, F.lit(queues)).cast("string")).alias("topic"),
        (F.lit(start_ns) + seq * gap_ns).alias("ts_ns"), F.when(seq % DELAYED_IN == 0, F.lit(DELAY_NS)).otherwise(F.lit(0)).cast("long").alias("delay_ns"),
        F.pmod(seq, F.lit(10)).cast("int").alias("priority"),
    )
