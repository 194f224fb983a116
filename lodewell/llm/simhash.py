"""SimHash near-duplicates: exact linking of fingerprints by pigeonring filtering.

A fingerprint's 64 bits are cut into ``SEGMENTS`` ring segments. If two
fingerprints differ in at most ``t`` bits, then from at least one start the
ring's running sums of differences keep within ``k * t / SEGMENTS`` after
every k segments (the pigeonring principle). With t = 2 and five segments the
first two segments of such a chain must be equal, so they are the bucket key;
the longer chains prune the bucket's pairs before the full Hamming check.

A bucket with more than ``BUCKET`` distinct fingerprints (a large family of
near copies, or sheer volume) is split by the chain's next segments, one after
the other, within the remaining budget: two members that differ in at most two
bits there are both within one bit of some value between them, so each goes to
the buckets of its own value and of those one bit away. A bucket split by all
segments holds 40 fingerprints at most, so nothing is quadratic in a family.
Buckets emit spanning links, at most one a member.

``near_dedup`` keeps one document of each group of near duplicates by shingle
similarity, see the module ``neardup``.

Defined results: null and blank texts have fingerprint zero and are one group;
rows with equal text share a fingerprint; an empty table gives an empty
result; a null doc_id never is a component's id (a group of only null ids has
a null component_id); further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import Table, write_table
from . import neardup
from .common import id_text, lower_words, map_batches, texts_of
from .components import connected_components

SEGMENTS = 5
#: Bits of each ring segment, from the lowest; they add up to 64.
WIDTHS = (13, 13, 13, 13, 12)
STARTS = tuple(sum(WIDTHS[:i]) for i in range(SEGMENTS))
BUCKET = 64
SEED = 42
_BLOCK = 1 << 15


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text's lower-cased word shingles; 0 without words."""
    w = lower_words(text)
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False)) if len(w) >= shingle else iter([b" ".join(w)])
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        size = min(_BLOCK, n - at)
        h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for _, g in zip(range(size), grams, strict=False)), np.uint64, size)
        bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(size, 64)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row (doc_id, fp) per document; fp holds the fingerprint's bits as a signed long."""

    def fn(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "fp": np.array([fingerprint(t, shingle) for t in texts_of(batch, "text")], np.uint64).view(np.int64)}

    return map_batches(id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")), fn, "doc_id long, fp long")


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, STARTS[i % SEGMENTS]).bitwiseAND(F.lit((1 << WIDTHS[i % SEGMENTS]) - 1))


def bucket_keys(fp: Column) -> Column:
    """For each start on the ring: the start, and its first two segments in one long."""
    return F.array(*(F.struct(F.lit(i).alias("start"), (F.shiftleft(_segment(fp, i), 16) + _segment(fp, i + 1)).alias("key")) for i in range(SEGMENTS)))


def _ring_links(fps: np.ndarray, start: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a bucket that pass every chain budget from ``start`` and the full check."""
    a, b = np.triu_indices(len(fps), 1)
    total = np.zeros(len(a), np.int64)
    x = fps[a] ^ fps[b]
    for k in range(1, SEGMENTS + 1):
        i = (start + k - 1) % SEGMENTS
        part = (x >> np.uint64(STARTS[i])) & np.uint64((1 << WIDTHS[i]) - 1)
        total += np.bitwise_count(part)
        keep = total * SEGMENTS <= k * distance
        a, b, x, total = a[keep], b[keep], x[keep], total[keep]
    return a, b


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    kept = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(i), find(j)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append((i, j))
    return kept


def _bit(b: int) -> Column:
    return F.lit((1 << b) - (1 << 64) * (b == 63)).cast("long")


def _split(hot: DataFrame, depth: int) -> DataFrame:
    """Rows (start, key, fp, used) of large buckets, dealt to buckets of the chain's segment ``depth``.

    ``used`` says that a row stands one bit off its own value already; no row stands two off.
    """
    centre, moves = None, None
    for start in range(SEGMENTS):
        i = (start + depth) % SEGMENTS
        off = F.array(F.lit(0).cast("long"), *(_bit(b) for b in range(STARTS[i], STARTS[i] + WIDTHS[i])))
        value = _segment(F.col("fp").bitwiseXOR(F.col("mask")), i)
        here = F.col("start") == start
        moves = F.when(here, off) if moves is None else moves.when(here, off)
        centre = F.when(here, value) if centre is None else centre.when(here, value)
    dealt = hot.select("start", "key", "fp", "used", F.explode(F.when(F.col("used"), F.array(F.lit(0).cast("long"))).otherwise(moves)).alias("mask"))
    return dealt.select("start", F.xxhash64("key", F.lit(depth), centre).alias("key"), "fp", (F.col("used") | (F.col("mask") != 0)).alias("used"))


def links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """Spanning links (u, v) between distinct fingerprints (fp) at ``distance`` (0 to 2) or fewer bits.

    Every two fingerprints that near are connected by the links, and each link
    is such a pair.
    """
    if not 0 <= distance <= 2:
        raise ValueError("the ring of five segments serves distances up to 2")
    rows = distinct.select("fp", F.explode(bucket_keys(F.col("fp"))).alias("b")).select("b.start", "b.key", "fp", F.lit(False).alias("used"))
    # One pass counts the buckets and already names both members of the many that have two.
    sizes = write_table(rows.groupBy("start", "key").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("n > 1"), "simhash-buckets")
    buckets = sizes.df.filter("n = 2").select("start", F.array("lo", "hi").alias("fps"))
    for depth in range(2, SEGMENTS + 1):
        last = depth == SEGMENTS  # split by every segment
        large = write_table(sizes.df.filter("n > 2").select("start", "key", "n"), "simhash-large")
        held = rows.join(large.joinable(), ["start", "key"])
        buckets = buckets.unionByName(held.filter("true" if last else F.col("n") <= BUCKET).groupBy("start", "key").agg(F.collect_list("fp").alias("fps")).select("start", "fps"))
        if last or large.df.filter(F.col("n") > BUCKET).isEmpty():
            break
        rows = write_table(_split(held.filter(F.col("n") > BUCKET), depth), "simhash-split").df
        sizes = write_table(rows.groupBy("start", "key").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("n > 1"), "simhash-buckets")
        buckets = buckets.unionByName(sizes.df.filter("n = 2").select("start", F.array("lo", "hi").alias("fps")))

    def fn(batch: pa.RecordBatch) -> dict:
        out: dict = {"u": [], "v": []}
        for start, fps in zip(batch.column("start").to_pylist(), batch.column("fps").to_pylist(), strict=True):
            fps = sorted(fps)
            own = np.array(fps, np.int64)
            a, b = _ring_links(own.view(np.uint64), start, distance)
            for i, j in _spanning(len(own), a, b):
                out["u"].append(fps[i])
                out["v"].append(fps[j])
        return out

    return map_batches(buckets, fn, "u long, v long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2) -> Table:
    """A written table (doc_id, fp, component_id): the smallest doc_id reachable over links."""
    own = write_table(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    distinct = write_table(own.df.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    roots = connected_components(links(distinct.df.select("fp"), distance)).df
    linked = roots.join(distinct.df, roots["node"] == distinct.df["fp"]).select("fp", "root", "rep")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    moved = linked.join(least, "root").select("fp", "least")
    by_fp = write_table(distinct.df.join(moved, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id")), "simhash-by-fp")
    # A plain join of two scans: a fingerprint with very many rows is a skewed partition that adaptive execution splits.
    return write_table(own.df.join(by_fp.df, "fp").select("doc_id", "fp", "component_id"), "simhash-components")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = neardup.SHINGLE, similarity: float = neardup.SIMILARITY) -> DataFrame:
    """The documents with one row of each group of near duplicates: the one with the smallest id.

    A group is connected by pairs whose word shingles have a Jaccard similarity
    of ``similarity`` or more. Columns are unchanged. Repeated ids count as
    copies, one of their rows stays; rows without an id can't be told apart and
    always stay.
    """
    found = neardup.groups(docs, id_col, text_col, shingle, similarity)
    return neardup.one_of_each(docs, found.df, id_col)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``."""
    return components(docs).df.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
