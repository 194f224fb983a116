"""Half-open integer intervals [start, end): union, subtraction, replay, overlap and remap joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import write_table
from .prefix import largest_key, next_value, prefix_max, prefix_sum


def merge(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Touching and overlapping intervals of a key as one; empty ones vanish.

    An interval starts an island if it starts after all earlier ends; an
    island's start is then the running maximum of such starts, so hot keys are
    split like any running maximum.
    """
    longest = df.select(*keys, F.col(start).alias("s"), F.col(end).alias("e")).filter("e > s").groupBy(*keys, "s").agg(F.max("e").alias("e"))
    own = write_table(longest, "intervals").df  # read three times
    largest = largest_key(own, keys)
    marked = prefix_max(own, keys, ["s"], F.col("e"), "reach", largest=largest)
    islands = prefix_max(marked, keys, ["s"], F.when(F.col("reach").isNull() | (F.col("s") > F.col("reach")), F.col("s")), "island", inclusive=True, largest=largest)
    return islands.groupBy(*keys, F.col("island").alias(start)).agg(F.max("e").alias(end))


def subtract(df: DataFrame, holes: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Disjoint intervals of a key without the parts that ``holes`` covers."""
    a = df.select(*keys, F.lit(1).alias("w"), start, end)
    b = holes.select(*keys, F.lit(0).alias("w"), start, end)
    return _sweep(a.unionByName(b), keys, start, end, F.col("_in") & ~F.col("_out"))


def intersect(df: DataFrame, other: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """The parts that both sides cover."""
    a = df.select(*keys, F.lit(1).alias("w"), start, end)
    b = other.select(*keys, F.lit(0).alias("w"), start, end)
    return _sweep(a.unionByName(b), keys, start, end, F.col("_in") & F.col("_out"))


def _sweep(both: DataFrame, keys: Sequence[str], start: str, end: str, keep) -> DataFrame:
    edges = both.filter(F.col(end) > F.col(start)).select(*keys, F.explode(F.array(F.struct(F.col(start).alias("at"), F.when(F.col("w") == 1, 1).otherwise(0).alias("a"), F.when(F.col("w") == 0, 1).otherwise(0).alias("b")), F.struct(F.col(end).alias("at"), F.when(F.col("w") == 1, -1).otherwise(0).alias("a"), F.when(F.col("w") == 0, -1).otherwise(0).alias("b")))).alias("x")).select(*keys, "x.*")
    steps = write_table(edges.groupBy(*keys, "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "edges").df
    largest = largest_key(steps, keys)
    counted = prefix_sum(prefix_sum(steps, keys, ["at"], F.col("a"), "_a", True, largest=largest), keys, ["at"], F.col("b"), "_b", True, largest=largest)
    level = next_value(counted, keys, "at", "_next", largest=largest).withColumn("_in", F.col("_a") > 0).withColumn("_out", F.col("_b") > 0)
    pieces = level.filter(keep & F.col("_next").isNotNull()).select(*keys, F.col("at").alias(start), F.col("_next").alias(end))
    return merge(pieces, keys, start, end)


def _painted(s: np.ndarray, e: np.ndarray, q: np.ndarray) -> list[tuple[int, int]]:
    """The runs whose last writer (greatest ``q``) is odd: ranges paint from the last back, each only what is still bare."""
    at = np.unique(np.concatenate([s, e]))
    first, last = np.searchsorted(at, s).tolist(), np.searchsorted(at, e).tolist()
    bare = list(range(len(at)))  # from each piece to the next one that is bare
    odd = np.zeros(len(at) + 1, bool)
    for i in np.argsort(-q, kind="stable").tolist():
        j, stop, colour = first[i], last[i], bool(q[i] & 1)
        while True:
            here = j
            while bare[here] != here:
                bare[here] = here = bare[bare[here]]
            if here >= stop:
                break
            odd[here + 1] = colour
            bare[here] = here + 1
            j = here + 1
    edges = np.flatnonzero(odd[1:] != odd[:-1]).tolist()  # the piece past the last boundary stays bare
    return [(int(at[a]), int(at[b])) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def replay(log: DataFrame, keys: Sequence[str], seq: str, kind: str, start: str = "start", end: str = "end", alloc: str = "alloc") -> DataFrame:
    """Allocated ranges after an ordered log of alloc and free entries: the last writer of every position decides.

    A key's positions are cut into blocks of about equally many boundaries. An
    entry goes, cut off, to the blocks where it begins and ends; what lies
    between is covered whole, and such covers meet in a binary tree over the
    blocks, a logarithmic number of nodes for each entry, of which only the
    last writer counts. Each block is then painted by itself, so neither a key
    with most of the log nor entries that span all others are gathered or
    compared piece by piece. ``seq`` is not negative and below 2^62.
    """
    # Order and kind in one number, so that the last writer is a plain maximum.
    mark = F.col(seq).cast("long") * 2 + (F.col(kind) == alloc).cast("long")
    own = log.filter(F.col(end) > F.col(start)).select(*keys, mark.alias("q"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
    entries = write_table(own.groupBy(*keys, "s", "e").agg(F.max("q").alias("q")), "entries").df
    points = entries.select(*keys, F.explode(F.array("s", "e")).alias("at")).distinct()
    # Written once: blocks are whatever the range sampling made of the partitions.
    dealt = write_table(points.repartitionByRange(*keys, "at").groupBy(*keys, F.spark_partition_id().alias("b")).agg(F.min("at").alias("lo")), "blocks")
    cuts = write_table(dealt.df.groupBy(*keys).agg(F.array_sort(F.collect_set("lo")).alias("cuts")), "cuts")  # one number for each partition at most

    def block(position: Column) -> Column:
        return F.size(F.filter("cuts", lambda c: c <= position)) - 1

    placed = write_table(entries.join(cuts.joinable(), list(keys)).withColumn("i", block(F.col("s"))).withColumn("j", block(F.col("e") - 1)), "placed").df
    inner = placed.filter("i = j").select(*keys, F.col("i").alias("b"), "s", "e", "q")
    head = placed.filter("i < j").select(*keys, F.col("i").alias("b"), "s", F.col("cuts")[F.col("i") + 1].alias("e"), "q")
    tail = placed.filter("i < j").select(*keys, F.col("j").alias("b"), F.col("cuts")[F.col("j")].alias("s"), "e", "q")
    most = placed.agg(F.max(F.size("cuts"))).first()[0] or 0
    levels = max(1, most.bit_length())
    nodes = []
    for k in range(levels):  # the whole blocks [i + 1, j) as nodes of the tree
        left, right = F.ceil((F.col("i") + 1) / F.lit(1 << k)), F.floor(F.col("j") / F.lit(1 << k))
        nodes.append(F.when((left < right) & (left % 2 == 1), F.struct(F.lit(k).alias("_level"), left.cast("int").alias("_node"))))
        nodes.append(F.when((left < right) & (right % 2 == 1), F.struct(F.lit(k).alias("_level"), (right - 1).cast("int").alias("_node"))))
    covers = placed.filter("i + 1 < j").select(*keys, "q", F.explode(F.array_compact(F.array(*nodes))).alias("_n")).select(*keys, "q", "_n.*").groupBy(*keys, "_level", "_node").agg(F.max("q").alias("q"))
    above = cuts.df.filter(F.size("cuts") > 2).select(*keys, "cuts", F.explode(F.sequence(F.lit(1), F.size("cuts") - 2)).alias("b")).select(*keys, "cuts", "b", F.explode(F.array(*(F.struct(F.lit(k).alias("_level"), F.shiftright("b", k).alias("_node")) for k in range(levels)))).alias("_n"))
    whole = above.select(*keys, "cuts", "b", "_n.*").join(covers, [*keys, "_level", "_node"]).groupBy(*keys, "b").agg(F.max("q").alias("q"), F.first("cuts").alias("cuts")).select(*keys, "b", F.col("cuts")[F.col("b")].alias("s"), F.col("cuts")[F.col("b") + 1].alias("e"), "q")
    # Equal pieces of a block, as cut-off entries often are, go as one.
    pieces = reduce(DataFrame.unionByName, (inner, head, tail, whole)).groupBy(*keys, "b", "s", "e").agg(F.max("q").alias("q"))
    schema = ", ".join([*(f"`{k}` {log.schema[k].dataType.simpleString()}" for k in keys), "s long", "e long"])

    def paint(group: pd.DataFrame) -> pd.DataFrame:
        runs = _painted(group["s"].to_numpy(), group["e"].to_numpy(), group["q"].to_numpy())
        out = pd.DataFrame(runs, columns=["s", "e"])
        for k in keys:
            out[k] = group[k].iloc[0]
        return out[[*keys, "s", "e"]]

    painted = pieces.groupBy(*keys, "b").applyInPandas(paint, schema)
    return merge(painted.withColumnsRenamed({"s": start, "e": end}), keys, start, end)


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_range: tuple[str, str], right_range: tuple[str, str]) -> DataFrame:
    """Pairs of a key whose ranges overlap, as equi-joins on cells of the longer range's size.

    A range's level is the least power of two that holds it. Two ranges meet at
    the higher of their levels, where each touches two cells at most, so a long
    range meets what lies in about its own length and short ranges meet in short
    cells, whatever else the table has. The shorter side goes to each level
    that the other side has; a pair is kept in the cell of the later start
    only, so it comes once.
    """
    ls, le = left_range
    rs, re_ = right_range
    lname = [c for c in left.columns if c not in keys]
    rname = [c for c in right.columns if c not in keys]

    def levelled(df: DataFrame, s: str, e: str) -> DataFrame:
        span = F.col(e).cast("long") - F.col(s).cast("long")
        return df.filter(F.col(e) > F.col(s)).withColumn("_level", F.when(span == 1, 0).otherwise(F.length(F.bin(span - 1))).cast("int"))

    def at(s: str | Column) -> Column:
        return F.call_function("shiftright", (F.col(s) if isinstance(s, str) else s).cast("long"), F.col("_level"))

    def celled(df: DataFrame, s: str, e: str) -> DataFrame:
        return df.withColumn("_cell", F.explode(F.sequence(at(s), at(F.col(e) - 1))))

    a, b = levelled(left, ls, le), levelled(right, rs, re_)
    both = a.select(F.lit(0).alias("side"), "_level").unionByName(b.select(F.lit(1).alias("side"), "_level")).distinct().collect()  # 128 rows at most
    levels = [sorted(r["_level"] for r in both if r["side"] == side) for side in (0, 1)]

    def raised(df: DataFrame, to: list[int], s: str, e: str, equal: bool) -> DataFrame:
        higher = F.filter(F.array(*map(F.lit, to)).cast("array<int>"), lambda x: x >= F.col("_level") if equal else x > F.col("_level"))
        return celled(df.withColumn("_level", F.explode(higher)), s, e)

    one = raised(a, levels[1], ls, le, True).join(celled(b, rs, re_), [*keys, "_level", "_cell"])
    two = celled(a, ls, le).join(raised(b, levels[0], rs, re_, False), [*keys, "_level", "_cell"])
    met = one.select(*keys, "_level", "_cell", *lname, *rname).unionByName(two.select(*keys, "_level", "_cell", *lname, *rname))
    return met.filter((F.col(ls) < F.col(re_)) & (F.col(rs) < F.col(le)) & (at(F.greatest(F.col(ls), F.col(rs))) == F.col("_cell"))).select(*keys, *lname, *rname)


def remap(reads: DataFrame, mapping: DataFrame, keys: Sequence[str], read_id: str) -> DataFrame:
    """Pieces of each read (off, len) through mapping entries (src, len, dst), in order, and whether they cover it whole.

    A gap makes the whole read an error (``covered`` false), never a short read.
    """
    r = reads.select(*keys, read_id, F.col("off").alias("a"), (F.col("off") + F.col("len")).alias("b"))
    m = mapping.select(*keys, F.col("src").alias("c"), (F.col("src") + F.col("len")).alias("d"), "dst")
    pieces = overlap_join(r, m, keys, ("a", "b"), ("c", "d"))
    cut = pieces.select(*keys, read_id, F.greatest("a", "c").alias("from_off"), F.least("b", "d").alias("to_off"), (F.col("dst") + F.greatest("a", "c") - F.col("c")).alias("dst_off"))
    sums = cut.groupBy(*keys, read_id).agg(F.sum(F.col("to_off") - F.col("from_off")).alias("got"), F.count("*").alias("pieces"))
    whole = r.join(sums, [*keys, read_id], "left").select(*keys, read_id, (F.coalesce("got", F.lit(0)) == F.col("b") - F.col("a")).alias("covered"), F.coalesce("pieces", F.lit(0)).alias("pieces"))
    return whole.join(cut, [*keys, read_id], "left")


def overlap_flag(ranges: DataFrame, taken: DataFrame, keys: Sequence[str], range_id: str, known: DataFrame | None = None, unreadable: str | None = None, start: str = "start", end: str = "end") -> DataFrame:
    """Whether each range meets a taken one: true, false, or null where that can't be known.

    ``known`` lists the keys whose maps exist, with the number of unreadable
    ones; a key that is not listed, or has unreadable maps and no hit, is null.
    A hit depends on the key and the range alone, so rows that repeat an id, or
    have none, are flagged each by its own.
    """
    t = taken.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"))
    asked = ranges.select(*keys, start, end).distinct()
    hits = overlap_join(asked, t, keys, (start, end), ("_s", "_e")).select(*keys, start, end).distinct().withColumn("_hit", F.lit(True))
    out = ranges.join(hits, [*keys, start, end], "left")
    hit = F.coalesce("_hit", F.lit(False))
    if known is None:
        return out.withColumn("allocated", hit).drop("_hit")
    out = out.join(known.select(*keys, F.col(unreadable).alias("_unreadable")), list(keys), "left")
    flag = F.when(F.col("_unreadable").isNull(), F.lit(None).cast("boolean")).when(hit, True).when(F.col("_unreadable") > 0, F.lit(None).cast("boolean")).otherwise(False)
    return out.withColumn("allocated", flag).drop("_hit", "_unreadable")
