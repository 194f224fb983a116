"""Chain-of-custody aggregates: what was recorded, where, and what superseded it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_kept(df: DataFrame, keys: Sequence[str], value: str, seq: str) -> DataFrame:
    """The first non-null value by ``seq`` for each key, and whether later ones disagree."""
    known = F.col(value).isNotNull()
    return df.groupBy(*keys).agg(F.min_by(value, F.when(known, F.col(seq))).alias(value), (F.max(value) != F.min(value)).alias("_differ")).withColumn("conflict", F.coalesce("_differ", F.lit(False))).drop("_differ")


def window_rollup(df: DataFrame, keys: Sequence[str], low: str, high: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(low).alias("low"), F.max(high).alias("high"))


def once_across_logs(df: DataFrame, log: str, record: Sequence[str]) -> DataFrame:
    """A record that stands in several logs counts in the first of them only; repeats within that log stay."""
    first = df.groupBy(*record).agg(F.min(log).alias("_first"))
    same = df[log] == first["_first"]
    for c in record:
        same = same & df[c].eqNullSafe(first[c])
    return df.join(first, same).select(df["*"])


def finished_later(df: DataFrame, keys: Sequence[str], seq: str, complete: Column) -> DataFrame:
    """Incomplete rows that a later complete row of the same keys finishes."""
    last = df.filter(complete).groupBy(*keys).agg(F.max(seq).alias("_done"))
    return df.filter(~complete).join(last, list(keys)).filter(F.col("_done") > F.col(seq)).drop("_done")


def outside_window(rows: DataFrame, windows: DataFrame, key: str, at: str) -> DataFrame:
    """Rows with the window of their key and a warning text where they lie outside it."""
    joined = rows.join(windows, key, "left")
    text = F.when(F.col("low").isNull(), "no window").when(F.col(at) < F.col("low"), "before window").when(F.col(at) > F.col("high"), "after window")
    return joined.withColumn("warning", text)
