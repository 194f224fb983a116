"""First-failure classification, profile misses, bands, histograms, samples and ranks."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import write_table


def first_failure(checks: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first check, in order, that a row fails (its condition is true); null if none."""
    return F.coalesce(*(F.when(failed, name) for name, failed in checks))


def misses(checks: Sequence[tuple[str, Column]]) -> Column:
    """All failing checks, in fixed order."""
    return F.array_compact(F.array(*(F.when(failed, name) for name, failed in checks)))


def rank_band(score: Column, matched: Column) -> Column:
    """Disjoint bands: 0.55 to 1 for a full profile match, 0 to 0.45 otherwise."""
    return F.when(matched, F.lit(0.55) + F.lit(0.45) * score).otherwise(F.lit(0.45) * score)


def counts_by(df: DataFrame, reason: str) -> DataFrame:
    """How often each reason occurs, most frequent first, then by name."""
    return df.filter(F.col(reason).isNotNull()).groupBy(reason).agg(F.count("*").alias("n")).orderBy(F.desc("n"), reason)


def histogram(df: DataFrame, value: Column, width: int) -> DataFrame:
    return df.groupBy((F.floor(value / width) * width).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def stride(key: Column, step: int) -> Column:
    """Evenly strided sample: every ``step``-th key."""
    return key % step == 0


def ranked_ids(df: DataFrame, order: Sequence[Column], limit: int | None = None, name: str = "id") -> DataFrame:
    """The first ``limit`` rows in order, or all rows, with ids c0001, c0002, ...

    With a limit Spark keeps that many rows of each task before they meet.
    Without one the rows are sorted in ranges, and a row's rank is that within
    its range after the counts of the ranges before it.
    """
    if limit:
        return df.orderBy(*order).limit(limit).withColumn(name, F.format_string("c%04d", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))))
    ranges = write_table(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges").df
    counts = ranges.groupBy("_range").count().orderBy("_range").collect()  # one row for each partition
    before = dict(zip((r["_range"] for r in counts), itertools.accumulate((r["count"] for r in counts), initial=0), strict=False))
    offset = F.coalesce(F.create_map(*(F.lit(x) for pair in before.items() for x in pair))[F.col("_range")], F.lit(0)) if before else F.lit(0)
    rank = offset + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.withColumn(name, F.format_string("c%04d", rank)).drop("_range")


def margin_winner(df: DataFrame, keys: Sequence[str], count: str, tie: str, least: int = 8, factor: int = 2) -> DataFrame:
    """Per key the row with the greatest count (of equals the least ``tie``), and whether it has ``least`` and ``factor`` times the runner-up's.

    Each task passes on two rows of a key at most.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(count), F.asc(tie)))
    two = df.withColumn("_place", place).filter("_place <= 2")
    best = F.max(F.when(F.col("_place") == 1, F.struct(F.col(tie).alias("t"), F.col(count).alias("c"))))
    top = two.groupBy(*keys).agg(best.alias("_top"), F.coalesce(F.max(F.when(F.col("_place") == 2, F.col(count))), F.lit(0)).alias("runner_up"))
    return top.select(*keys, F.col("_top.t").alias(tie), F.col("_top.c").alias(count), "runner_up", ((F.col("_top.c") >= least) & (F.col("_top.c") >= factor * F.col("runner_up"))).alias("clear"))
