"""Evidence logs as a stream: records are appended and never rewritten, so a file's lines only grow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.evidence import RECORD, VERSION


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the log files that appear in a folder; lines that are none, or of another version, are left out."""
    lines = spark.readStream.format("text").load(folder)
    parsed = lines.select(F.from_json("value", RECORD, {"mode": "PERMISSIVE"}).alias("r"), F.col("value").alias("text"))
    return parsed.filter(F.col("r.v") == VERSION).select("r.*", "text", F.get_json_object("text", "$.result").alias("result"))


def follow(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand all records that are there to ``sink``, batch by batch; a later call goes on where this one ended."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
