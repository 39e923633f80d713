"""Frames of the broker's socket protocol, for captured traffic.

A frame is [command: u8][length: u32 little-endian][payload]; payloads above 4 MiB
aren't accepted.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylog.functions.scalars import MAX_FRAME_BYTES

_HEADER = struct.Struct("<BI")

#: The command bytes by name.
COMMANDS = {
    "publish": 0x01, "publish_topic": 0x02, "consume": 0x03, "ack": 0x04, "nack": 0x05, "ping": 0x06, "stats": 0x07, "auth": 0x08, "prefetch": 0x09,
    "cluster_join": 0x10, "cluster_leave": 0x11, "cluster_status": 0x12, "confirm_select": 0x13, "exchange_declare": 0x14, "exchange_delete": 0x15,
    "bind_queue": 0x16, "unbind_queue": 0x17, "publish_exchange": 0x18,
}


def encode(command: int, payload: bytes) -> bytes:
    return _HEADER.pack(command, len(payload)) + payload


def decode(stream: BinaryIO) -> Iterator[tuple[int, bytes]]:
    """(command, payload) up to the end, a frame that is cut off, or one that is too large."""
    while len(header := stream.read(_HEADER.size)) == _HEADER.size:
        command, length = _HEADER.unpack(header)
        if length > MAX_FRAME_BYTES:
            return
        payload = stream.read(length)
        if len(payload) < length:
            return
        yield command, payload


def named(frames: DataFrame, column: str = "command") -> DataFrame:
    """frames with `name`: the command byte's name, null for unknown ones."""
    names = F.create_map(*[F.lit(x) for name, byte in COMMANDS.items() for x in (byte, name)])
    return frames.withColumn("name", F.try_element_at(names, F.col(column).cast("int")))
