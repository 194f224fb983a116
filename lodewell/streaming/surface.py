"""The surface scan as a stream: its checkpoint is what makes it resumable."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..decode import carve
from ..plans.commands import surface_hits
from ..sources import blocks


def hits(spark: SparkSession, paths: list[str], profile: carve.Profile | None = None, codecs: tuple[str, ...] = (), chunk: int = blocks.CHUNK, batch: int = 16) -> DataFrame:
    """Hits and rejections of every chunk, ``batch`` chunks at a time."""
    blocks.register(spark)
    raw = spark.readStream.format("blockmember").option("paths", json.dumps(paths)).option("chunk", chunk).option("batch", batch).load()
    return surface_hits(raw, profile or carve.Profile(), False, codecs, chunk)


def run(stream: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Scan what is left, then end; stop it at any time and call again to resume."""
    return stream.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
