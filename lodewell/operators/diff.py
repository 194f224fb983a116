"""What differs between versions: set differences, full diffs, histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import write_table
from .prefix import prefix_max


def only_in(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose keys ``right`` has not."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def full_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], facts: Sequence[str]) -> DataFrame:
    """Keys of either side with both sides' facts and a class: created, destroyed, changed or same.

    Keys are unique on each side. Facts are compared null-safely.
    """
    b = before.select(*keys, F.lit(True).alias("_b"), *(F.col(f).alias(f"before_{f}") for f in facts))
    a = after.select(*keys, F.lit(True).alias("_a"), *(F.col(f).alias(f"after_{f}") for f in facts))
    joined = b.join(a, list(keys), "full")
    same = F.lit(True)
    for f in facts:
        same = same & F.col(f"before_{f}").eqNullSafe(F.col(f"after_{f}"))
    kind = F.when(F.col("_b").isNull(), "created").when(F.col("_a").isNull(), "destroyed").when(same, "same").otherwise("changed")
    return joined.select(*keys, *(F.col(f"before_{f}") for f in facts), *(F.col(f"after_{f}") for f in facts), kind.alias("change"))


def version_events(states: DataFrame, version: str, key: str, fact: str, versions: DataFrame) -> DataFrame:
    """Events between consecutive versions of a whole table.

    ``states`` has one row per version and key; ``versions`` lists the versions
    that could be read, as (version, next), a few rows: an event belongs to
    the later one. Each state stands once as what its own version has and once
    as what the next one had before, and the two meet in one aggregation:
    created, changed, destroyed. The first version is the base.
    """
    known = versions.select(F.col(version).alias("v"), "next", (F.col(version) == F.min(version).over(Window.partitionBy(F.lit(0)))).alias("base"))
    rows = states.select(F.col(version).alias("v"), F.col(key).alias("k"), F.col(fact).alias("f")).join(write_table(known, "versions").joinable(), "v")
    nothing = F.lit(None).cast(states.schema[fact].dataType)
    here = F.when(~F.col("base"), F.struct(F.col("v").alias("at"), F.lit(False).alias("had"), F.lit(True).alias("has"), nothing.alias("old"), F.col("f").alias("new")))
    later = F.when(F.col("next").isNotNull(), F.struct(F.col("next").alias("at"), F.lit(True).alias("had"), F.lit(False).alias("has"), F.col("f").alias("old"), nothing.alias("new")))
    met = rows.select("k", F.explode(F.array_compact(F.array(here, later))).alias("x")).select("k", "x.*")
    both = met.groupBy("at", "k").agg(F.max("had").alias("had"), F.max("has").alias("has"), F.max("old").alias("old"), F.max("new").alias("new"))
    kind = F.when(~F.col("had"), "created").when(~F.col("has"), "destroyed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.select(F.col("at").alias(version), F.col("k").alias(key), kind.alias("kind"), F.col("old").alias("before"), F.col("new").alias("after")).filter("kind is not null")


def event_order(kind: Column, kinds: Sequence[str]) -> Column:
    """The position of a kind in the fixed order of kinds (not its name)."""
    return F.array_position(F.array(*(F.lit(k) for k in kinds)), kind).cast("int") - 1


def last_seen(states: DataFrame, version: str, key: str, latest: Column) -> DataFrame:
    """Keys that were gone at the latest version, and when each was last there."""
    return states.groupBy(key).agg(F.max(version).alias("last_seen")).filter(F.col("last_seen") < latest)


def abandoned(df: DataFrame, keys: Sequence[str], order: str, at: str) -> DataFrame:
    """Rows whose ``at`` lies before an earlier row's: history that was rolled back.

    The witness is the earlier row with the greatest ``at`` (the first such
    one). Dropped rows never raise the maximum, so the running maximum over
    all rows is the one over the kept rows.
    """
    marked = prefix_max(df, keys, [order], F.struct(F.col(at).alias("at"), (-F.col(order)).alias("neg")), "_top")
    return marked.filter(F.col(at) < F.col("_top")["at"]).withColumn("witness", -F.col("_top")["neg"]).withColumn("witness_at", F.col("_top")["at"]).drop("_top")


def carried_over(earlier: DataFrame, later: DataFrame, key: str, name: str, prefixes: Sequence[str], joints: Sequence[str] = ("/", "@")) -> DataFrame:
    """Earlier rows below an unread prefix that the later version lacks: carried over, not destroyed."""
    inside = F.lit(False)
    for p in prefixes:
        inside = inside | (F.col(name) == p)
        for j in joints:
            inside = inside | F.col(name).startswith(p + j)
    return only_in(earlier.filter(inside), later, [key])
