"""A message as one line of JSON, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The envelope's names on the wire, the tables' columns for them, and their types.
FIELDS = {
    "id": ("id", "string"), "topic": ("topic", "string"), "payload": ("payload", "string"), "headers": ("headers", "map<string,string>"),
    "timestamp": ("timestamp_ns", "bigint"), "retry": ("retry", "int"), "max_retry": ("max_retry", "int"), "delivery_count": ("delivery_count", "int"),
    "delay": ("delay_ns", "bigint"), "ttl": ("ttl_ns", "bigint"), "deliver_at": ("deliver_at", "bigint"), "expires_at": ("expires_at", "bigint"),
    "priority": ("priority", "int"), "exchange": ("exchange_name", "string"), "routing_key": ("routing_key", "string"),
}


def encode(*names: str) -> Column:
    """The named fields (all without names) of a row with the tables' columns as JSON; nulls are left out."""
    return F.to_json(F.struct(*[F.col(FIELDS[n][0]).cast(FIELDS[n][1]).alias(n) for n in names or FIELDS]))


def decode(line: Column) -> Column:
    """A struct of all fields by their names on the wire; null where the line isn't JSON, or a field isn't in it."""
    return F.from_json(line, ", ".join(f"{n} {kind}" for n, (_, kind) in FIELDS.items()))


def headers_text(headers: Column) -> Column:
    """Headers as 'key=value' in order of the keys, joined by '&'."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))), "&")
