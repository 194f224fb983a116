"""Running maxima and sums that hold up when one key owns a large part of the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import write_table

#: Rows of one key that a single task may order by itself.
KEY_ROWS = 2_000_000


def largest_key(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the key that has the most; a caller with several running values counts once."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def _running(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: Column, name: str, inclusive: bool, key_rows: int, largest: int | None, fold: Callable[[Column], Column], both: Callable[[Column, Column], Column]) -> DataFrame:
    """``fold`` of ``value`` over earlier rows; ``both`` joins a block's own part with what the blocks before carry on.

    While every key has at most ``key_rows`` rows this is one window. Beyond
    that rows are dealt in order to blocks that may split a key; each block
    adds the fold of the blocks before it, one row for each key and block.
    """
    end = Window.currentRow if inclusive else -1
    if (largest_key(df, keys) if largest is None else largest) <= key_rows:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        return df.withColumn(name, fold(value).over(w))
    dealt = df.repartitionByRange(*keys, *order).withColumn("_block", F.spark_partition_id())
    blocks = write_table(dealt, "prefix-blocks").df  # written, so that a task that runs again meets the same blocks
    within = Window.partitionBy("_block", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.groupBy("_block", *keys).agg(fold(value).alias("_own")).withColumn("_carry", fold(F.col("_own")).over(before)).drop("_own")
    same = blocks["_block"] == carried["_block"]
    for k in keys:
        same = same & blocks[k].eqNullSafe(carried[k])
    joined = blocks.join(carried, same).select(blocks["*"], "_carry").withColumn("_own", fold(value).over(within))
    return joined.withColumn(name, F.when(F.col("_own").isNull(), F.col("_carry")).when(F.col("_carry").isNull(), F.col("_own")).otherwise(both(F.col("_own"), F.col("_carry")))).drop("_own", "_carry", "_block")


def prefix_max(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: Column, name: str, inclusive: bool = False, key_rows: int = KEY_ROWS, largest: int | None = None) -> DataFrame:
    """``df`` with the running maximum of ``value`` over earlier rows of the same keys; null where there is none.

    Rows are ordered by ``order``, which must tell rows of a key apart.
    ``value`` may be a struct (its maximum is the greatest first field), which
    makes "the last row that ..." a running maximum too.
    """
    return _running(df, keys, order, value, name, inclusive, key_rows, largest, F.max, lambda own, carry: F.when(carry > own, carry).otherwise(own))


def prefix_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: Column, name: str, inclusive: bool = False, key_rows: int = KEY_ROWS, largest: int | None = None) -> DataFrame:
    """The same for the running sum."""
    return _running(df, keys, order, value, name, inclusive, key_rows, largest, F.sum, lambda own, carry: own + carry)


def next_value(df: DataFrame, keys: Sequence[str], at: str, name: str, key_rows: int = KEY_ROWS, largest: int | None = None) -> DataFrame:
    """The next greater ``at`` of the same keys; ``at`` tells rows of a key apart."""
    return prefix_max(df, keys, [F.desc(at)], -F.col(at), name, key_rows=key_rows, largest=largest).withColumn(name, -F.col(name))
