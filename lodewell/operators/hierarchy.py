"""Trees kept as (id, parent) rows: paths, pre-order, prefixes, quorums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import write_table


def paths(edges: DataFrame, node: str, parent: str, name: str, separator: str = "/", max_depth: int = 64) -> DataFrame:
    """(node, path, depth) of everything below the roots (rows without a parent).

    One join a level, so the number of rounds is the depth of the tree. A node
    already reached is not reached again: loops end, and at ``max_depth`` the
    walk stops with an error instead of running on.
    """
    level = write_table(edges.filter(F.col(parent).isNull()).select(F.col(node).alias("n"), F.col(name).alias("path"), F.lit(0).alias("depth")), "paths")
    seen = level.df
    for _ in range(max_depth):
        step = edges.select(F.col(node).alias("child"), F.col(parent).alias("n"), F.col(name).alias("part")).join(level.df, "n").select(F.col("child").alias("n"), F.concat_ws(separator, "path", "part").alias("path"), (F.col("depth") + 1).alias("depth"))
        level = write_table(step.join(seen.select("n"), "n", "left_anti"), "paths")
        if level.df.isEmpty():
            return seen.select(F.col("n").alias(node), "path", "depth")
        seen = seen.unionByName(level.df)
    raise ValueError(f"deeper than {max_depth} levels")


def pre_order(path: Column, separator: str = "/") -> Column:
    """Sort key that lists a tree depth first, siblings by name."""
    return F.split(path, separator)


def in_scope(name: Column, prefix: str, joint: str = "/") -> Column:
    """The named node and everything below it."""
    return (name == prefix) | name.startswith(prefix + joint)


def readable(children: DataFrame, group: str, present: Column, kind: Column, parity: Column) -> DataFrame:
    """Whether each group can be read: mirrors need one member, parity groups lose at most ``parity``."""
    agg = children.groupBy(group).agg(F.count_if(~present).alias("missing"), F.count("*").alias("members"), F.max(kind).alias("kind"), F.max(parity).alias("parity"))
    ok = F.when(F.col("kind") == "mirror", F.col("missing") < F.col("members")).when(F.col("kind") == "parity", F.col("missing") <= F.col("parity")).otherwise(F.col("missing") == 0)
    return agg.withColumn("readable", ok)
