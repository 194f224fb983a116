"""Newest-wins and as-of selection; every tie side is stated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import prefix_max


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the one with the greatest ``order``, by partial aggregation (no sort, no window).

    Descending tie-breakers are given negated; null keys form one group.
    """
    rest = [c for c in (columns or df.columns) if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order))))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, *(F.col("_best")[c].alias(c) for c in rest))


def last_writer(df: DataFrame, keys: Sequence[str], seq: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Last row by ``seq`` for each key."""
    return newest(df, keys, [F.col(seq)], columns)


def as_of(df: DataFrame, keys: Sequence[str], at: Column, limit: Column, tie: Sequence[Column] = ()) -> DataFrame:
    """The newest row per key with ``at`` not after ``limit``."""
    return newest(df.filter(at <= limit), keys, [at, *tie])


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, payload: Sequence[str], prefix: str = "prev_", tie: Sequence[str] = ()) -> DataFrame:
    """Each left row with the payload of the last right row of its keys that is not later.

    Spark has no as-of join: both sides become one ordered stream and the last
    right row is a running maximum. A right row at the same instant counts.
    Equal instants among right rows go to the greatest ``tie``.
    """
    shape = [F.col(right_at).alias("at"), *(F.col(t).alias(f"t{i}") for i, t in enumerate(tie)), *(F.col(p).alias(p) for p in payload)]
    lcols = left.columns
    one = left.select(*keys, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.struct(*lcols).alias("_row"), F.monotonically_increasing_id().alias("_n"), F.lit(None).cast(right.select(F.struct(*shape).alias("s")).schema["s"].dataType).alias("_right"))
    two = right.select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(one.schema["_row"].dataType).alias("_row"), F.monotonically_increasing_id().alias("_n"), F.struct(*shape).alias("_right"))
    both = prefix_max(one.unionByName(two), keys, ["_at", "_side", "_n"], F.col("_right"), "_last", inclusive=True)
    kept = both.filter("_side = 1")
    return kept.select(*(F.col("_row")[c].alias(c) for c in lcols), *(F.col("_last")[p].alias(prefix + p) for p in payload))
