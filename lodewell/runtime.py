"""Session helpers: the shared scratch folder and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables up to this many bytes on disk may be broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def reach_workers(spark: SparkSession) -> None:
    """Let the Python workers import this package from where the driver has it, if that folder is there for them too."""
    here = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if here not in known:
        environment["PYTHONPATH"] = os.pathsep.join([here, *filter(None, known)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local-mode session without the setting gets a temporary folder,
    because there driver and executors are one process.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    given = spark.sparkContext._jsc.sc().getCheckpointDir()  # set in code instead
    if known or given.isDefined():
        return (known or given.get()).rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="lodewell-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _filesystem(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


class Table:
    """A DataFrame written once as Parquet under the shared folder."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path = spark, path
        self.df: DataFrame = spark.read.schema(schema).parquet(path)

    def bytes(self) -> int:
        where, fs = _filesystem(self.spark, self.path)
        return fs.getContentSummary(where).getLength()

    def joinable(self) -> DataFrame:
        """The table with a broadcast hint if it is proven small, else for a shuffled hash join."""
        return F.broadcast(self.df) if self.bytes() <= BROADCAST_BYTES else self.df.hint("shuffle_hash")

    def drop(self) -> None:
        where, fs = _filesystem(self.spark, self.path)
        fs.delete(where, True)


_cleaned: set[str] = set()


def _own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/lodewell-{spark.sparkContext.applicationId}"
    if path not in _cleaned:
        _cleaned.add(path)

        def clean() -> None:
            with contextlib.suppress(Exception):  # the JVM may be gone already
                where, fs = _filesystem(spark, path)
                fs.delete(where, True)

        atexit.register(clean)
    return path


def write_table(df: DataFrame, name: str) -> Table:
    """Cut the lineage of ``df``: write it to the shared folder and read it back.

    Unlike a local checkpoint the rows outlive any executor; unlike a cached
    frame nothing is recomputed after a loss.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return Table(spark, path, df.schema)
