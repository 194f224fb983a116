"""Near-duplicates by shingle similarity: SimHash signatures, pigeonring pruning, exact verification.

Two documents are linked if the sets of their lower-cased word shingles have a
Jaccard similarity of ``similarity`` or more. At five words and 0.8 such sets
differ in about 39 of 256 SimHash bits, too many for ring segments to serve as
bucket keys; so candidates come from shared least shingles, and the SimHash
ring prunes them before the full check:

1. Equal sets are one node. A node has its set's size, a 256-bit SimHash and
   ``MINIMA`` least values of its shingles under different mixings.
2. Nodes with two equal least values in one of ``PAIRS`` tables share a
   bucket. A pair at 0.8 shares one with a probability of 0.9997.
3. In a bucket of up to ``BUCKET`` nodes, pairs of sizes too different go, then
   those without a chain of ring segments within the proportional budgets,
   then those whose whole fingerprints differ in over ``DISTANCE`` bits.
4. A larger bucket (a large family, or a passage that many texts share) is
   left, and each of its nodes goes to ``DEEP`` buckets of ``DEPTH`` equal least
   values instead, of which a pair at 0.8 shares one with a probability of
   0.9994. What is over ``BUCKET`` even there is a family of near copies: each
   node meets the bucket's pivot, another one in each bucket, so the work is
   linear in the family. That is a start only, see 6.
5. The remaining pairs are verified on the whole sets, but those that verified
   ones have connected already need no check: first each node meets its nearest
   candidate, then, round by round, more and more of the nearest pairs between
   each two components do, until no unchecked pair joins two components.
6. Larger buckets are then settled exactly: their nodes are dealt to blocks, and
   in each pair of blocks all sets that the links so far have not connected are
   compared whole, but for those of sizes too different and those that share an
   earlier table's bucket, where they met already. A component with a block or
   more of a bucket has blocks of its own, which do not meet each other. So
   two nodes that share any bucket, however large, are linked if they are
   similar enough.

Groups are the components over the verified links.

Defined results: null and blank texts have the empty set and are one group; a
text of fewer words than a shingle is one shingle; rows with equal ids are one
document; a row without an id is in no group; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Table, write_table
from .common import id_text, lower_words, map_batches, texts_of
from .components import connected_components

SHINGLE, SIMILARITY = 5, 0.8
VIEWS, SEGMENT = 4, 8
SEGMENTS = VIEWS * 64 // SEGMENT
DISTANCE = 80
#: Segments that a pruning chain has.
CHAIN = 4
MINIMA, PAIRS, DEEP, DEPTH = 32, 8, 14, 4
BUCKET = 32
#: Pairs between two components that the first round after the nearest checks, and how many times as many each further one does.
FIRST, MORE = 4, 16
#: Nodes and shingles that a block of a larger bucket has on average at most, and shingles that are counted at a time.
BLOCK, WEIGHT, COUNTED = 512, 1 << 18, 4096
_BLOCK = 4096


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


_STEP, _FACTORS, _OFFSETS, _MIXES = _odd(1, 1)[0], _odd(2, MINIMA), _odd(3, MINIMA), _odd(4, VIEWS)
#: Which least values make the key of each bucket, and of each deep one.
PAIR_KEYS = [[2 * t, 2 * t + 1] for t in range(PAIRS)]
DEEP_KEYS = [sorted(np.random.default_rng(100 + t).choice(MINIMA, DEPTH, replace=False).tolist()) for t in range(DEEP)]


def _mix(x: np.ndarray) -> np.ndarray:
    for factor in (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)):
        x = (x ^ x >> np.uint64(33)) * factor
    return x ^ x >> np.uint64(33)


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's lower-cased word shingles."""
    w = lower_words(text)
    if not w:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    n = max(1, len(w) - size + 1)
    total = np.full(n, min(size, len(w)), np.uint64)
    for i in range(min(size, len(w))):
        total = (total << np.uint64(23) | total >> np.uint64(41)) * _STEP + own[i : i + n]
    return np.unique(_mix(total))


def signature(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(SimHash words of each view, least values) of a shingle set."""
    ones = np.zeros(VIEWS * 64, np.int64)
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), _BLOCK):
        part = own[at : at + _BLOCK, None]
        bits = np.unpackbits(_mix(part ^ _MIXES).view(np.uint8), bitorder="little").reshape(len(part), -1)
        for row in range(0, len(bits), 255):  # sums of bytes that can't overflow
            ones += np.add.reduce(bits[row : row + 255], axis=0, dtype=np.uint8)
        least = np.minimum(least, (part * _FACTORS + _OFFSETS).min(axis=0))
    return np.packbits((2 * ones > len(own)).astype(np.uint8), bitorder="little").view(np.uint64), least


def _signatures(own: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, set_id, size, fp, least) of every row of (doc_id, text); equal sets have equal set_ids."""

    def fn(batch: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": batch.column("doc_id"), "set_id": [], "size": [], "fp": [], "least": []}
        for text in texts_of(batch, "text"):
            s = shingle_set(text, shingle)
            fp, least = signature(s)
            out["set_id"].append(xxhash.xxh3_128_digest(s.tobytes()))
            out["size"].append(len(s))
            out["fp"].append(fp.view(np.int64))
            out["least"].append(least.view(np.int64))
        return out

    return map_batches(own, fn, "doc_id long, set_id binary, size long, fp array<long>, least array<long>")


def prune(sizes: np.ndarray, fps: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, bits apart) of the pairs of a bucket that pass the size bound, a chain of ring segments and the full check."""
    a, b = np.triu_indices(len(sizes), 1)
    keep = np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b])
    a, b = a[keep], b[keep]
    apart = np.bitwise_count((fps[a] ^ fps[b]).view(np.uint8)).reshape(len(a), SEGMENTS)
    ring = np.concatenate([apart, apart[:, : CHAIN - 1]], axis=1).astype(np.int64)
    within = np.ones((len(a), SEGMENTS), bool)  # starts whose chain keeps within k * DISTANCE / SEGMENTS after every k segments
    total = np.zeros((len(a), SEGMENTS), np.int64)
    for k in range(CHAIN):
        total += ring[:, k : k + SEGMENTS]
        within &= total * SEGMENTS <= (k + 1) * DISTANCE
    keep = within.any(axis=1)
    a, b, bits = a[keep], b[keep], apart[keep].sum(axis=1, dtype=np.int64)
    keep = bits <= DISTANCE
    return a[keep], b[keep], bits[keep]


def _keyed(nodes: DataFrame, keys: list[list[int]], *columns: str) -> DataFrame:
    """(node, size, columns, table, key): each node in the bucket of each table that its least values give."""
    return nodes.select("node", "size", *columns, F.posexplode(_keys(keys)).alias("table", "key"))


def _keys(keys: list[list[int]]) -> Column:
    return F.array(*(F.xxhash64(F.lit(t), *(F.col("least")[i] for i in key)) for t, key in enumerate(keys)))


def _bucketed(keyed: DataFrame, similarity: float, name: str) -> tuple[DataFrame, Table]:
    """(pairs (u, v, bits) of the buckets of 2 to BUCKET nodes, written keys of larger ones) of (key, node, size, fp)."""
    sizes = write_table(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), f"{name}-buckets")
    small = write_table(sizes.df.filter(F.col("n") <= BUCKET).select("key"), f"{name}-small")
    large = write_table(sizes.df.filter(F.col("n") > BUCKET).select("key"), f"{name}-large")
    lists = keyed.join(small.joinable(), "key").groupBy("key").agg(F.collect_list(F.struct("node", "size", "fp")).alias("held"))

    def fn(batch: pa.RecordBatch) -> dict:
        out: dict = {"u": [], "v": [], "bits": []}
        for held in batch.column("held").to_pylist():
            held.sort(key=lambda x: x["node"])
            a, b, bits = prune(np.array([x["size"] for x in held]), np.array([x["fp"] for x in held], np.int64).view(np.uint64), similarity)
            out["u"] += [held[i]["node"] for i in a.tolist()]
            out["v"] += [held[i]["node"] for i in b.tolist()]
            out["bits"] += bits.tolist()
        return out

    return map_batches(lists, fn, "u long, v long, bits int"), large


def _stars(hot: DataFrame, similarity: float) -> DataFrame:
    """Pairs of each node of a bucket with the bucket's pivot, the node of least hash there."""
    order = F.xxhash64("key", "node")
    pivots = write_table(hot.groupBy("key").agg(F.min_by(F.struct(F.col("node").alias("pivot"), F.col("size").alias("pivot_size"), F.col("fp").alias("pivot_fp")), order).alias("p")).select("key", "p.*"), "near-pivots")
    met = hot.join(pivots.joinable(), "key").filter("node != pivot")
    bits = sum((F.bit_count(F.col("fp")[i].bitwiseXOR(F.col("pivot_fp")[i])) for i in range(VIEWS)), F.lit(0))
    near = met.withColumn("bits", bits.cast("int")).filter((F.least("size", "pivot_size") >= F.lit(similarity) * F.greatest("size", "pivot_size")) & (F.col("bits") <= DISTANCE))
    return near.select(F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("v"), "bits")


def candidates(nodes: DataFrame, similarity: float = SIMILARITY) -> tuple[Table, Table]:
    """(Written pairs (u, v, bits) of (node, size, fp, least) that may be similar, written keys of the buckets that are not paired wholly)."""
    shared = nodes.filter("size > 0")
    keyed = _keyed(shared, PAIR_KEYS, "fp")
    pairs, large = _bucketed(keyed, similarity, "near")
    left = write_table(keyed.join(large.joinable(), "key").select("node").distinct(), "near-hot")
    again = _keyed(shared.join(left.joinable(), "node"), DEEP_KEYS, "fp")
    deep, larger = _bucketed(again, similarity, "near-deep")
    every = pairs.unionByName(deep).unionByName(_stars(again.join(larger.joinable(), "key"), similarity))
    return write_table(every.groupBy("u", "v").agg(F.min("bits").alias("bits")), "near-pairs"), large


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets (node, own) have that Jaccard similarity or more."""
    one = pairs.select("u", "v").join(sets.select(F.col("node").alias("v"), F.col("own").alias("right")), "v")
    both = one.join(sets.select(F.col("node").alias("u"), F.col("own").alias("left")), "u")

    def fn(batch: pa.RecordBatch) -> dict:
        keep = []
        for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
            common = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
            keep.append(common >= similarity * ((len(x) + len(y)) // 8 - common) - 1e-9)
        mask = pa.array(keep, pa.bool_())
        return {"u": batch.column("u").filter(mask), "v": batch.column("v").filter(mask)}

    return map_batches(both.select("u", "v", "left", "right"), fn, "u long, v long")


def _sets(own: DataFrame, nodes: DataFrame, wanted: DataFrame, shingle: int) -> Table:
    """Written (node, own) for the wanted nodes, computed again from their texts."""
    chosen = write_table(nodes.select("node", "set_id", "rep").join(wanted, "node"), "near-chosen")
    texts = own.join(chosen.joinable(), own["doc_id"] == F.col("rep")).select("node", "set_id", "text")

    def fn(batch: pa.RecordBatch) -> dict:
        found = [shingle_set(t, shingle).tobytes() for t in texts_of(batch, "text")]
        # Another row with the same id may hold another text.
        mask = pa.array([xxhash.xxh3_128_digest(s) == k for s, k in zip(found, batch.column("set_id").to_pylist(), strict=True)], pa.bool_())
        return {"node": batch.column("node").filter(mask), "own": pa.array(found, pa.binary()).filter(mask)}

    return write_table(map_batches(texts, fn, "node long, own binary").dropDuplicates(["node"]), "near-sets")


def _nearest(pairs: DataFrame) -> DataFrame:
    """The pairs that are the nearest of one of their nodes."""
    ends = F.explode(F.array("u", "v")).alias("node")
    return pairs.select("u", "v", "bits", ends).groupBy("node").agg(F.min(F.struct("bits", "u", "v")).alias("p")).select("p.u", "p.v").distinct()


def _links(pairs: Table, sets: Table, similarity: float) -> DataFrame:
    """Verified pairs (u, v) that connect whatever the verified ones among all pairs would."""
    asked = write_table(_nearest(pairs.df), "near-asked")
    links = write_table(verified(asked.df, sets.df, similarity), "near-links")
    rest, found, most = pairs.df.join(asked.df, ["u", "v"], "left_anti"), links.df, FIRST
    while True:
        if not links.df.isEmpty():
            roots = connected_components(found).df
            for end in ("u", "v"):
                side = roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
                rest = rest.drop(f"root_{end}").join(side, end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
        elif most == FIRST:
            rest = rest.withColumns({"root_u": F.col("u"), "root_v": F.col("v")})
        between = Window.partitionBy(F.least("root_u", "root_v"), F.greatest("root_u", "root_v")).orderBy("bits", "u", "v")
        open_ = write_table(rest.filter("root_u != root_v").withColumn("place", F.row_number().over(between)), "near-open")
        if open_.df.isEmpty():
            return found
        links = write_table(verified(open_.df.filter(F.col("place") <= most), sets.df, similarity), "near-links")
        rest, found, most = open_.df.filter(F.col("place") > most).drop("place"), found.unionByName(links.df), most * MORE


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[list[int], list[int]]:
    """The edges (u, v) that join two trees of the ones before them."""
    root: dict = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    kept: tuple[list[int], list[int]] = ([], [])
    for a, b in np.unique(np.stack([u, v], axis=1), axis=0).tolist():
        p, q = find(a), find(b)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept[0].append(a)
            kept[1].append(b)
    return kept


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set of the one side shares with each of the other."""
    flat = [np.concatenate(side) for side in (left, right)]
    owner = [np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in (left, right)]
    shared = np.intersect1d(*flat)
    out = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, len(shared), COUNTED):
        part = shared[at : at + COUNTED]
        has = []
        for values, rows, side in zip(flat, owner, (left, right), strict=True):
            place = np.minimum(np.searchsorted(part, values), len(part) - 1)
            found = part[place] == values
            one = np.zeros((len(side), len(part)), np.float32)  # sums up to COUNTED are exact
            one[rows[found], place[found]] = 1
            has.append(one)
        out += (has[0] @ has[1].T).astype(np.int64)
    return out


def compared(table: int, root: np.ndarray, keys: np.ndarray, own: list[np.ndarray], first: np.ndarray, second: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """Edges (u, v) of a spanning forest over the roots of the similar sets ``own`` of two blocks of a table's bucket, or of one block, given twice.

    Sets of one root are connected already; sets that share an earlier table's bucket have met there.
    """
    sizes = np.array([len(x) for x in own])
    wide, long = np.ix_(first, second)
    open_ = (root[wide] != root[long]) & (np.minimum(sizes[wide], sizes[long]) >= similarity * np.maximum(sizes[wide], sizes[long]))
    for t in range(table):
        open_ &= keys[:, t][wide] != keys[:, t][long]
    if first is second:
        open_ = np.triu(open_, 1)
    rows, columns = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
    if not len(rows):
        return [], []
    first, second, open_ = first[rows], second[columns], open_[np.ix_(rows, columns)]
    common = _common([own[i] for i in first], [own[i] for i in second])
    i, j = np.nonzero(open_ & (common >= similarity * (sizes[first][:, None] + sizes[second] - common) - 1e-9))
    ends = root[first[i]], root[second[j]]
    return _forest(np.minimum(*ends), np.maximum(*ends))


def _large_links(nodes: DataFrame, large: Table, roots: DataFrame, own: DataFrame, similarity: float, shingle: int) -> DataFrame | None:
    """Links (u, v) between roots, or none, that all similar pairs within the ``large`` buckets of PAIR_KEYS give beyond ``roots`` (node, root)."""
    if large.df.isEmpty():
        return None
    keyed = _keyed(nodes.filter("size > 0").withColumn("keys", _keys(PAIR_KEYS)), PAIR_KEYS, "keys")
    held = keyed.join(large.joinable(), "key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = write_table(held, "near-large-rows").df
    counts = write_table(rows.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("weight")), "near-large-counts").df
    several = counts.groupBy("key").agg(F.count("*").alias("roots")).filter("roots > 1").select("key")
    # Nodes are not negative, so -1 marks the roots that share blocks.
    dealt = write_table(counts.join(several, "key", "left_semi").withColumn("part", F.when(F.col("n") >= BLOCK, F.col("root")).otherwise(F.lit(-1).cast("long"))), "near-large-dealt")
    if dealt.df.isEmpty():
        return None
    blocks = F.greatest(F.ceil(F.sum("n") / F.lit(BLOCK)), F.ceil(F.sum("weight") / F.lit(WEIGHT))).cast("long")
    parts = write_table(dealt.df.groupBy("key", "part").agg(blocks.alias("blocks")), "near-large-parts")
    every = parts.df.select("key", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    one, two = (every.select("key", F.col("part").alias(f"part_{x}"), F.col("block").alias(f"block_{x}")) for x in "ab")
    met = one.join(two, "key").filter("part_a < part_b or (part_a = -1 and part_b = -1 and block_a <= block_b)")
    pair = ["key", "part_a", "block_a", "part_b", "block_b"]
    met = write_table(met, "near-large-met").df
    sides = met.select(*pair, F.col("part_a").alias("part"), F.col("block_a").alias("block"), F.lit(0).alias("side"))
    sides = sides.unionByName(met.filter("part_a != part_b or block_a != block_b").select(*pair, F.col("part_b").alias("part"), F.col("block_b").alias("block"), F.lit(1).alias("side")))
    placed = rows.join(dealt.df.select("key", "root", "part"), ["key", "root"]).join(parts.df, ["key", "part"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    placed = write_table(placed.select("key", "part", "block", "table", "node", "root", "keys"), "near-large-placed").df
    sets = _sets(own, nodes, placed.select("node").distinct(), shingle).df
    spread = placed.join(sets, "node").join(sides, ["key", "part", "block"]).select(*pair, "side", "table", "root", "keys", "own")

    def fn(group: pa.Table) -> pa.Table:
        sides_ = group.column("side").to_numpy()
        keys = np.array(group.column("keys").to_pylist(), np.int64)
        first = np.flatnonzero(sides_ == 0)
        second = np.flatnonzero(sides_ == 1) if group.column("block_a")[0] != group.column("block_b")[0] or group.column("part_a")[0] != group.column("part_b")[0] else first
        sets_ = [np.frombuffer(x, np.uint64) for x in group.column("own").to_pylist()]
        u, v = compared(group.column("table")[0].as_py(), group.column("root").to_numpy(), keys, sets_, first, second, similarity)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return write_table(spread.groupBy(*pair).applyInArrow(fn, "u long, v long"), "near-large-links").df


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> Table:
    """A written table (doc_id, group_id): the smallest doc_id that verified links reach, itself included."""
    own = id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).filter("doc_id is not null")
    signed = write_table(_signatures(own, shingle), "near-signed")
    merged = signed.df.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("least").alias("least"))
    nodes = write_table(merged.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    pairs, large = candidates(nodes.df, similarity)
    wanted = pairs.df.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    links = _links(pairs, _sets(own, nodes.df, wanted, shingle), similarity)
    roots = connected_components(links).df
    more = _large_links(nodes.df, large, roots, own, similarity, shingle)
    if more is not None and not more.isEmpty():
        roots = connected_components(links.unionByName(more)).df
    # Rows with one id are one document, so sets that share an id are one group too.
    return _least(signed.df.select("doc_id", "set_id"), nodes.df.select("node", "set_id"), roots)


def _least(rows: DataFrame, nodes: DataFrame, roots: DataFrame) -> Table:
    numbered = write_table(nodes.join(roots, "node", "left").select("set_id", F.coalesce("root", "node").alias("root")), "near-roots")
    placed = write_table(rows.join(numbered.df, "set_id").select("doc_id", "root").distinct(), "near-placed")
    several = placed.df.groupBy("doc_id").agg(F.min("root").alias("u"), F.max("root").alias("v")).filter("u != v")
    every = write_table(placed.df.join(several.select("doc_id"), "doc_id", "left_semi").join(several, "doc_id").select("u", F.col("root").alias("v")).filter("u != v"), "near-ids")
    if not every.df.isEmpty():
        joined = connected_components(every.df).df.select(F.col("node").alias("root"), F.col("root").alias("top"))
        placed = write_table(placed.df.join(joined, "root", "left").select("doc_id", F.coalesce("top", "root").alias("root")).distinct(), "near-placed")
    least = placed.df.groupBy("root").agg(F.min("doc_id").alias("group_id"))
    return write_table(placed.df.join(least, "root").select("doc_id", "group_id"), "near-groups")


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """The documents with one row of each group: the one whose id is the group's. ``found`` has a row (doc_id, group_id) for each id.

    Of rows that repeat that id one stays; rows without an id can't be told apart and always stay.
    """
    gone = write_table(found.filter("doc_id != group_id").select(F.col("doc_id").alias("_gone")).distinct(), "near-gone")
    lost = gone.joinable()
    kept = docs.join(lost, docs[id_col].cast("long") == lost["_gone"], "left_anti")
    again = write_table(docs.groupBy(F.col(id_col).cast("long").alias("_again")).count().filter("count > 1 and _again is not null").select("_again"), "near-again")
    if again.df.isEmpty():
        return kept
    more = again.joinable()
    once = kept.join(more, kept[id_col].cast("long") == more["_again"], "left_semi").dropDuplicates([id_col])
    return kept.join(more, kept[id_col].cast("long") == more["_again"], "left_anti").unionByName(once)
