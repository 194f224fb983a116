"""Connected components by alternating large-star and small-star rounds, all distributed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..runtime import Table, write_table


#: A node with more than this share of the edges, and HOT_ROWS, is hot: there are fewer than 2 / HOT_SHARE such nodes.
HOT_SHARE, HOT_ROWS = 0.001, 1_000


#: So many edges one task settles by itself, without a round of jobs.
FEW = 10_000


def _settled(edges: DataFrame) -> DataFrame:
    """(node, root) of at most FEW edges."""
    kind = edges.schema["u"].dataType
    schema = StructType([StructField("node", kind), StructField("root", kind)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def find(x):
            root.setdefault(x, x)
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for batch in batches:
            for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, arrow.field(0).type), pa.array([find(x) for x in nodes], arrow.field(1).type)], schema=arrow)

    return edges.select("u", "v").repartition(1).mapInArrow(run, schema)


def _star(edges: DataFrame, large: bool, count: int) -> DataFrame:
    """One star step on ``count`` edges with u > v: every edge's far end is tied to the least node about its near end.

    The least nodes are pre-aggregated. Edges of hot nodes meet theirs by a
    broadcast of those few rows, so no task gathers a hot node's edges; all
    others by a shuffle.
    """
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = write_table(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "cc-least")
    limit = max(HOT_ROWS, HOT_SHARE * count)
    hot, rest = least.df.filter(F.col("n") > limit).select("u", "m"), least.df.filter(F.col("n") <= limit).select("u", "m")
    own = near.filter("v > u") if large else near
    few = F.broadcast(hot)
    tied = own.join(few, "u").unionByName(own.join(F.broadcast(hot.select("u")), "u", "left_anti").join(rest, "u"))
    out = tied.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.df.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def connected_components(edges: DataFrame, rounds: int = 100) -> Table:
    """Table (node, root) for every node of undirected ``edges`` (u, v); root is the least node.

    At most FEW edges are settled by one task. Else each round writes its edges to the shared folder, so a lost executor costs
    one step at most; superseded rounds are deleted.
    """
    now = write_table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "cc-edges")
    seen = None
    for _ in range(rounds):
        mark = now.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            break
        if seen is None and mark[0] <= FEW:
            return write_table(_settled(now.df), "cc-roots")
        seen = mark
        wide = write_table(_star(now.df, True, mark[0]), "cc-large")
        then = write_table(_star(wide.df, False, mark[0]), "cc-small")
        wide.drop()
        now.drop()
        now = then
    else:
        raise RuntimeError("components did not settle")
    nodes = now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return write_table(nodes.unionByName(now.df.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "cc-roots")
