"""What the operators of this subpackage share: words, row-wise Arrow maps, split rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: The six ASCII white-space characters that end a word (space and \x09-\x0D).
ASCII_SPACE = " \t\n\x0b\x0c\r"


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes; bytes.split() cuts at exactly those six."""
    return text.split()


def lower_words(text: bytes) -> list[bytes]:
    """The same after lower-casing A-Z; bytes.lower() leaves every other byte alone."""
    return text.lower().split()


def hash_bucket(key: Column, modulus: int) -> Column:
    """crc32 of a key's text modulo ``modulus``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def strings_of(batch: pa.RecordBatch, name: str) -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


#: Rows of an Arrow batch of texts: a batch is held by the JVM, in transfer and by Python. Of these, so many are Python objects at a time.
BATCH_ROWS, SLICE = 1_000, 512


def short_batches(spark: SparkSession) -> None:
    """Let the session hand at most ``BATCH_ROWS`` rows at a time to Python, however long their texts are."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: StructType | str) -> DataFrame:
    """mapInArrow where ``fn`` turns a short batch into columns (name -> values)."""
    short_batches(df.sparkSession)
    target = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(target)

    def column(values, kind: pa.DataType) -> pa.Array:
        return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                out = fn(batch.slice(at, SLICE))
                yield pa.RecordBatch.from_arrays([column(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, target)


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the id and the text, under fixed names, so that other columns can't clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
