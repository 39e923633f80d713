"""Per-row rules of the broker and of its dashboard, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the broker.
PRIORITY_LEVELS = 10
MAX_FRAME_BYTES = 4194304
DLQ_SUFFIX = "_dead_letter"
DEFAULT_MAX_RETRY = 5


def clamp_priority(p: Column) -> Column:
    """The level 0 to 9 that a raw priority falls into."""
    return F.least(F.greatest(p, F.lit(0)), F.lit(PRIORITY_LEVELS - 1)).cast("int")


def is_dead(retry: Column, max_retry: Column | int) -> Column:
    """Rejected more often than the limit allows; at the limit a message is alive."""
    return retry > max_retry


def queue_order(level: Column, seq: Column) -> Column:
    """One number that sorts by falling level, then rising seq (seq below 2^58)."""
    return (F.lit(PRIORITY_LEVELS - 1).cast("long") - level) * F.lit(1 << 58) + seq


def next_power_of_two(n: Column) -> Column:
    """The smallest power of two that isn't below n; 1 for anything up to 1."""
    n = n.cast("long")
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n - 1))))


def remaining_ttl_ms(expires_at: Column, as_of: int) -> Column:
    """-1 without an expiry, 0 when it's over, else the whole milliseconds left."""
    return F.when(expires_at == 0, F.lit(-1)).when(expires_at <= as_of, F.lit(0)).otherwise(F.floor((expires_at - as_of) / 1000000)).cast("long")


def is_json(text: Column) -> Column:
    return F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))


def unwrap_json_string(text: Column) -> Column:
    """The content of a JSON string; anything else as it is."""
    return F.when(text.rlike(r'(?s)^\s*".*"\s*$'), F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v"), text)).otherwise(text)


def parse_int(text: Column) -> Column:
    """Blank is 0, a signed run of digits its value, all else null."""
    t = F.trim(text)
    return F.when(t == "", F.lit(0).cast("long")).when(t.rlike("^[+-]?[0-9]+$"), t.try_cast("long"))


def _div(a: Column, b: int) -> Column:
    """Whole quotient of numbers that aren't negative, without going through floats."""
    return F.floor((a - F.pmod(a, F.lit(b))).cast("decimal(38,0)") / F.lit(b)).cast("long")


def format_number(n: Column) -> Column:
    """1.23M, 4.5K or the number itself; halves are rounded up."""
    n = n.cast("long")
    m, k = _div(n + 5000, 10000), _div(n + 50, 100)
    return (
        F.when(n >= 1000000, F.concat(_div(m, 100).cast("string"), F.lit("."), F.lpad(F.pmod(m, F.lit(100)).cast("string"), 2, "0"), F.lit("M")))
        .when(n >= 1000, F.concat(_div(k, 10).cast("string"), F.lit("."), F.pmod(k, F.lit(10)).cast("string"), F.lit("K")))
        .otherwise(n.cast("string"))
    )


def format_bytes(n: Column) -> Column:
    """Bytes in the largest unit of 1024 that fits, with at most two decimals and no trailing zeros."""
    n = n.cast("long")
    out = F.when(n == 0, F.lit("0 B"))
    for power, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        size = 1024**power
        h = _div(n * 200 + size, 2 * size)
        rest = F.pmod(h, F.lit(100))
        number = F.concat(
            _div(h, 100).cast("string"),
            F.when(rest == 0, F.lit("")).when(F.pmod(rest, F.lit(10)) == 0, F.concat(F.lit("."), _div(rest.cast("long"), 10).cast("string"))).otherwise(F.concat(F.lit("."), F.lpad(rest.cast("string"), 2, "0"))),
        )
        out = out.when(n >= size, F.concat(number, F.lit(" " + unit)))
    return out


def format_uptime(ms: Column) -> Column:
    """hh:mm:ss."""
    s = _div(ms.cast("long"), 1000)
    two = lambda x: F.when(F.length(x.cast("string")) < 2, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
    return F.concat_ws(":", two(_div(s, 3600)), two(_div(F.pmod(s, F.lit(3600)), 60)), two(F.pmod(s, F.lit(60))))


def format_ttl(ms: Column) -> Column:
    """Milliseconds, seconds, minutes, or hours with one decimal."""
    ms = ms.cast("long")
    t = _div(ms + 180000, 360000)
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60000, F.concat(_div(ms + 500, 1000).cast("string"), F.lit("s")))
        .when(ms < 3600000, F.concat(_div(ms + 30000, 60000).cast("string"), F.lit("m")))
        .otherwise(F.concat(_div(t, 10).cast("string"), F.lit("."), F.pmod(t, F.lit(10)).cast("string"), F.lit("h")))
    )


def truncate_value(text: Column, longest: int = 80) -> Column:
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit("..."))).otherwise(text)


def gauge_percent(x: Column, most: float) -> Column:
    return F.least(x.cast("double") / F.lit(float(most)) * 100, F.lit(100.0))


def seed_list(text: Column) -> Column:
    """A comma-separated list: trimmed, without empty entries, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(text, ",", -1), lambda s: F.trim(s)), lambda s: s != ""))


def peer_id(text: Column) -> Column:
    return F.split_part(text, F.lit("@"), F.lit(1))


def peer_address(text: Column) -> Column:
    """What follows the '@'; without one, the whole text."""
    return F.coalesce(F.nullif(F.split_part(text, F.lit("@"), F.lit(2)), F.lit("")), text)


def dead_letter_name(queue: Column) -> Column:
    return F.concat(queue, F.lit(DLQ_SUFFIX))


def durable_queue(topic: Column, subscriber: Column) -> Column:
    """The queue that keeps a topic's messages for a durable subscriber."""
    return F.concat_ws(":", topic, subscriber)


def dead_letter_source(name: Column) -> Column:
    return F.regexp_replace(name, DLQ_SUFFIX + "$", "")


def glob_match(pattern: str, key: Column) -> Column:
    """'' and '*' match all, '*x*' contains, 'x*' begins, '*x' ends, else equality; other stars are literal."""
    if pattern in ("", "*"):
        return F.lit(True)
    if len(pattern) > 1 and pattern.startswith("*") and pattern.endswith("*"):
        return key.contains(pattern[1:-1])
    if pattern.endswith("*"):
        return key.startswith(pattern[:-1])
    if pattern.startswith("*"):
        return key.endswith(pattern[1:])
    return key == pattern


def wal_record_bytes(data: Column) -> Column:
    """Size of a log record: 8 bytes of header, 1 of type, the data."""
    return (F.coalesce(F.octet_length(data), F.lit(0)) + 9).cast("long")
