"""The sparse image sink, and the guard that keeps outputs off the evidence."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


class Overlap(ValueError):
    """An output would be written onto an input."""


def guard(output: str, inputs: list[str]) -> None:
    """Refuse an output that resolves onto an input, by path or by inode, or that lies on a device."""
    real = os.path.realpath(output)
    for path in inputs:
        if os.path.realpath(path) == real or (os.path.exists(output) and os.path.samefile(output, path)):
            raise Overlap(f"{output} is the input {path}")
    if real.startswith("/dev/"):
        raise Overlap(f"{output} is a device")


def create(path: str, size: int) -> None:
    """An image of ``size`` holes, replacing nothing that exists."""
    fd = os.open(path, os.O_RDWR | os.O_CREAT | os.O_EXCL, 0o644)
    try:
        os.truncate(fd, size)
    finally:
        os.close(fd)


def write_blocks(blocks: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """Rows (off, data, ...) written at their places by each task; gives back the other columns.

    Ranges are disjoint and a task that runs again writes the same bytes, so a
    lost executor does no harm. Null data leaves a hole. The image stands in a
    folder that all executors see.
    """
    keep = blocks.select(*columns).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fd = os.open(path, os.O_WRONLY)
        try:
            for batch in batches:
                for off, data in zip(batch.column("off").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    if data is not None:
                        os.pwrite(fd, data, off)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns], names=columns)
            os.fsync(fd)
        finally:
            os.close(fd)

    return blocks.mapInArrow(run, keep)
