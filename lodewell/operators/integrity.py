"""Digests, verdicts, parity and running sums as column expressions and aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2^64 as a decimal, for sums that wrap like unsigned 64-bit words.
WORD = "18446744073709551616"


def digests(data: Column) -> list[Column]:
    """SHA-256 always, SHA-1 and MD5 beside it."""
    raw = data.cast("binary")
    return [F.sha2(raw, 256).alias("sha256"), F.sha1(raw).alias("sha1"), F.md5(raw).alias("md5")]


def verdict(recorded: Column, computed: Column) -> Column:
    """PASS, FAIL, MISSING (nothing to compare with) or UNHASHED (nothing was recorded); never null."""
    return F.when(computed.isNull(), "MISSING").when(recorded.isNull(), "UNHASHED").when(recorded == computed, "PASS").otherwise("FAIL")


def parity(word: Column) -> Column:
    return F.bit_xor(word)


def wrap(total: Column) -> Column:
    return total % F.lit(WORD).cast("decimal(38,0)")


def cascaded_sums(df: DataFrame, keys: Sequence[str], position: str, word: str, count: str) -> DataFrame:
    """Three cascaded running sums over a key's words in order, from one aggregation.

    The k-th sum is the closed form of k nested prefix sums: each word weighs
    by how many of them it still goes through, so no order is needed.
    """
    left = (F.col(count) - F.col(position)).cast("decimal(38,0)")
    w = F.col(word).cast("decimal(38,0)")
    one = F.lit(1).cast("decimal(38,0)")
    second = (w * left).cast("decimal(38,0)")
    third = (w * (left * (left + one) / F.lit(2)).cast("decimal(38,0)")).cast("decimal(38,0)")
    return df.groupBy(*keys).agg(wrap(F.sum(w)).cast("decimal(38,0)").alias("a"), wrap(F.sum(second)).cast("decimal(38,0)").alias("b"), wrap(F.sum(third)).cast("decimal(38,0)").alias("c"))


def both_ways(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with the side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
