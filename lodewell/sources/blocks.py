"""Members as rows of byte ranges: a batch and a streaming data source, read only."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..pool.members import Member

SCHEMA = "member int, off bigint, data binary, bad array<struct<off:bigint,len:bigint>>"
CHUNK, OVERLAP = 4 << 20, 16 << 10


class Range(InputPartition):
    def __init__(self, member: int, path: str, start: int, end: int, refused: list):
        super().__init__((member, path, start, end, refused))


def ranges(options: dict) -> list[Range]:
    """One partition per ``chunk`` bytes of each member, within ``start`` and ``end`` if given."""
    chunk = int(options.get("chunk", CHUNK))
    refused = json.loads(options.get("refused", "{}"))
    out = []
    for i, path in enumerate(json.loads(options["paths"])):
        fd = os.open(path, os.O_RDONLY)
        try:
            size = os.lseek(fd, 0, os.SEEK_END)
        finally:
            os.close(fd)
        for at in range(int(options.get("start", 0)), min(size, int(options.get("end", size))), chunk):
            out.append(Range(i, path, at, min(size, at + chunk, int(options.get("end", size))), refused.get(str(i), [])))
    return out


def read_range(partition: Range, overlap: int) -> Iterator[tuple]:
    """The range and a tail beyond it, so that a structure that starts in it is whole; refused bytes are zeros and listed."""
    member, path, start, end, refused = partition.value
    source = Member(path, [tuple(r) for r in refused])
    try:
        stop = min(source.size, end + overlap)
        data, bad = source.salvage(start, stop - start)
    finally:
        source.close()
    yield member, start, data, [(a, n) for a, n in bad]


class BlockMember(DataSource):
    """format("blockmember"): option paths (JSON list), chunk, overlap, start, end, refused (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "blockmember"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Batch(dict(self.options))

    def streamReader(self, schema):
        return _Stream(dict(self.options))


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        return ranges(self.options)

    def read(self, partition: Range) -> Iterator[tuple]:
        return read_range(partition, int(self.options.get("overlap", OVERLAP)))


class _Stream(DataSourceStreamReader):
    """The same ranges as a stream: the offset is how many of them are done, so a scan resumes from its checkpoint."""

    def __init__(self, options: dict):
        self.options, self.all = options, ranges(options)
        self.step = int(options.get("batch", 16))
        self.given = 0

    def initialOffset(self) -> dict:
        return {"done": 0}

    def latestOffset(self) -> dict:
        self.given = min(len(self.all), self.given + self.step)
        return {"done": self.given}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.given = max(self.given, end["done"])
        return self.all[start["done"] : end["done"]]

    def read(self, partition: Range) -> Iterator[tuple]:
        return read_range(partition, int(self.options.get("overlap", OVERLAP)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BlockMember)
