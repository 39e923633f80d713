"""The brokers' binary log as a data source.

A record is [length: u32 little-endian][crc32: u32 little-endian][type: u8][data];
length and checksum (CRC-32, IEEE) cover type and data. A segment is read from its
start to the first record that is cut off, empty or fails its checksum, since
nothing after that can be trusted. The format has no marks to split at, so a
segment is one task; write logs as many segments.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

_HEADER = struct.Struct("<II")

#: What a segment holds, record by record; a writer needs rec_type and data.
SCHEMA = "segment string, seq bigint, rec_type int, data binary"


def encode(rec_type: int, data: bytes) -> bytes:
    body = bytes([rec_type]) + data
    return _HEADER.pack(len(body), zlib.crc32(body)) + body


def decode(stream: BinaryIO) -> Iterator[tuple[int, bytes]]:
    """(type, data) of the records up to the first that can't be read."""
    while len(header := stream.read(_HEADER.size)) == _HEADER.size:
        length, checksum = _HEADER.unpack(header)
        if length < 1:
            return
        body = stream.read(length)
        if len(body) < length or zlib.crc32(body) != checksum:
            return
        yield body[0], body[1:]


#: A segment's name: the commit that wrote it, a mark of its own, the task.
_SEGMENT = re.compile(r"segment-(\d+)-[0-9a-f]+-\d+\.wal")


def _place(path: str) -> tuple:
    """The file system of a path (local, hdfs://, s3://, gs:// ...) and the folder on it."""
    from pyarrow import fs

    local = re.fullmatch(r"file:/*(/.*)", path)
    if local or "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(local.group(1) if local else path)
    return fs.FileSystem.from_uri(path)


def _segments(path: str) -> list[str]:
    from pyarrow import fs

    system, folder = _place(path)
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and f.base_name.endswith(".wal"))


@dataclass
class _Segment(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Segment]:
        return [_Segment(p) for p in _segments(self.path)] or [_Segment("")]

    def read(self, partition: _Segment) -> Iterator[tuple]:
        if not partition.path:
            return
        name = os.path.basename(partition.path)
        with _place(self.path)[0].open_input_stream(partition.path, buffer_size=1 << 20) as f:
            for seq, (kind, data) in enumerate(decode(f)):
                yield name, seq, kind, data


@dataclass
class _Written(WriterCommitMessage):
    draft: str


class _Writer(DataSourceWriter):
    """Each task writes a draft; the commit renames the drafts of the tasks that counted, so retried tasks leave no doubles.

    Segments are numbered by commit, so what is appended comes after what was there,
    and carry a mark of the commit, so that two writers at one time don't overwrite
    each other. Overwriting removes the older segments once the new ones are there.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator) -> _Written:
        system, folder = _place(self.path)
        system.create_dir(folder, recursive=True)
        draft = f"{folder}/.{uuid.uuid4().hex}.draft"
        with system.open_output_stream(draft, buffer_size=1 << 16) as f:
            for row in rows:
                f.write(encode(row["rec_type"], bytes(row["data"])))
        return _Written(draft)

    def commit(self, messages: list[_Written | None]) -> None:
        system, folder = _place(self.path)
        older = _segments(self.path)
        last = max((int(m.group(1)) for p in older if (m := _SEGMENT.fullmatch(os.path.basename(p)))), default=0)
        mark = uuid.uuid4().hex[:12]
        for i, m in enumerate(messages):
            if m:
                system.move(m.draft, f"{folder}/segment-{last + 1:010d}-{mark}-{i:06d}.wal")
        for p in older if self.overwrite else []:
            system.delete_file(p)

    def abort(self, messages: list[_Written | None]) -> None:
        system, _ = _place(self.path)
        for m in messages:
            if m and system.get_file_info(m.draft).is_file:
                system.delete_file(m.draft)


class WalSource(DataSource):
    """format("wal"): option path is a folder that driver and workers share, on any file system that pyarrow.fs opens."""

    @classmethod
    def name(cls) -> str:
        return "wal"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WalSource)
