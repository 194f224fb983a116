"""Benchmark decontamination by a hash set of normalised test n-grams.

Words are ASCII-lower-cased runs of letters, digits and non-ASCII characters.
Each benchmark item gives its windows of ``n`` words (a shorter item one
window of all its words). The windows are numbered; their words form a small
dictionary, so a document is first turned into runs of known words and only
those runs are looked up, window by window, and verified word for word (the
set's keys are the words themselves, so a hash never decides alone).

The set is broadcast only if the benchmark is under ``MAX_BYTES`` of text. A
larger benchmark goes through in blocks of that size, each a pass with its
own bounded set, and the passes' hit positions are merged by document; results
are the same. Removal cuts by the merged positions of all blocks, and scans what
it has cut against all of them again.

Defined results: null or wordless texts and items hit nothing; items that
repeat an id count once; an item without an id hits, but is not counted or
named among a document's items; repeated documents are reported one by one; extra
columns are ignored (and kept by ``remove_contaminated``).
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import write_table
from .common import id_text, map_batches, texts_of

WINDOW = 10
#: Benchmark text that one broadcast set may stand for.
MAX_BYTES = 8 << 20

#: A-Z become a-z; every other ASCII byte that is no digit or letter becomes a space.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def item_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(TABLE).split()


class WindowSet:
    """Exact n-gram set: windows keyed by their word numbers, grouped by window length."""

    def __init__(self, items: Iterable[tuple[str | None, bytes]], n: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.by_length: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, text in items:
            w = [self.ids.setdefault(x, len(self.ids)) for x in item_words(text)]
            if w:
                size = min(n, len(w))
                table = self.by_length.setdefault(size, {})
                for i in range(len(w) - size + 1):
                    found = table.setdefault(tuple(w[i : i + size]), set())
                    if item is not None:
                        found.add(item)
        self.shortest = min(self.by_length, default=0)

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, merged hit word ranges [from, to), and the items with occurring windows."""
        w = item_words(text)
        if not self.by_length or len(w) < self.shortest:
            return len(w), [], set()
        get = self.ids.get
        known = [get(x, -1) for x in w]
        known.append(-1)
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        at = 0
        while at < len(w):
            try:
                end = known.index(-1, at)
            except ValueError:
                end = len(w)
            if end - at >= self.shortest:
                for size, table in self.by_length.items():
                    for i in range(at, end - size + 1):
                        if (found := table.get(tuple(known[i : i + size]))) is not None:
                            spans.append((i, i + size))
                            items |= found
            at = end + 1
        return len(w), merged(spans), items


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(items: DataFrame, item_col: str, text_col: str, max_bytes: int) -> list[DataFrame]:
    """The benchmark, or blocks of it by item hash, each of about ``max_bytes`` of text at most."""
    own = items.select(F.col(item_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // max_bytes) or 1
    return [own] if n == 1 else [own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


_SCHEMA = "doc_id long, n_words long, spans array<struct<a:long,b:long>>, items array<string>"


def _scan(docs: DataFrame, block: DataFrame, n: int) -> DataFrame:
    spark = docs.sparkSession
    windows = WindowSet(((r["item_id"], r["text"].encode()) for r in block.collect()), n)  # bounded by MAX_BYTES
    shared = spark.sparkContext.broadcast(windows)

    def fn(batch: pa.RecordBatch) -> dict:
        found = [shared.value.scan(t) for t in texts_of(batch, "text")]
        return {"doc_id": batch.column("doc_id"), "n_words": [x[0] for x in found], "spans": [[{"a": a, "b": b} for a, b in x[1]] for x in found], "items": [sorted(x[2]) for x in found]}

    return map_batches(docs, fn, _SCHEMA)


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = WINDOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Per document row: doc_id, n_words, spans (merged word ranges) and items (sorted ids)."""
    own = id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    blocks = _blocks(items, item_col, item_text, max_bytes)
    if len(blocks) == 1:
        return _scan(own, blocks[0], n)
    # Rows with equal id and text have equal hits, so passes meet on (id, text digest) and rows are dealt back by a count.
    keyed = own.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    spans = reduce(DataFrame.unionByName, (_scan_keyed(keyed, block, n) for block in blocks))
    parts = write_table(spans, "leak-passes").df
    once = parts.filter("size(spans) > 0").groupBy("doc_id", "digest").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    rows = keyed.select(F.col("doc_id"), "digest", "text")
    joined = rows.join(once, rows["doc_id"].eqNullSafe(once["doc_id"]) & (rows["digest"] == once["digest"]), "left").select(rows["doc_id"], "text", "spans", "items")

    def fn(batch: pa.RecordBatch) -> dict:
        ranges = [merged((s["a"], s["b"]) for s in x or []) for x in batch.column("spans").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "n_words": [len(item_words(t)) for t in texts_of(batch, "text")], "spans": [[{"a": a, "b": b} for a, b in x] for x in ranges], "items": [x or [] for x in batch.column("items").to_pylist()]}

    return map_batches(joined, fn, _SCHEMA)


def _scan_keyed(keyed: DataFrame, block: DataFrame, n: int) -> DataFrame:
    spark = keyed.sparkSession
    shared = spark.sparkContext.broadcast(WindowSet(((r["item_id"], r["text"].encode()) for r in block.collect()), n))

    def fn(batch: pa.RecordBatch) -> dict:
        found = [shared.value.scan(t) for t in texts_of(batch, "text")]
        return {"doc_id": batch.column("doc_id"), "digest": batch.column("digest"), "spans": [[{"a": a, "b": b} for a, b in x[1]] for x in found], "items": [sorted(x[2]) for x in found]}

    return map_batches(keyed, fn, "doc_id long, digest string, spans array<struct<a:long,b:long>>, items array<string>")


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WINDOW, max_share: float = 0.2, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Documents without benchmark passages, columns unchanged.

    Hit words, with what stands between them, are cut out of the text; a
    document of which more than ``max_share`` of the words are hit goes
    altogether. Untouched texts stay byte for byte.
    """
    blocks = _blocks(items, "item_id", "text", max_bytes)
    if len(blocks) > 1:
        return _remove_in_rounds(docs, blocks, text_col, n, max_share)
    shared = docs.sparkSession.sparkContext.broadcast(WindowSet(((r["item_id"], r["text"].encode()) for r in blocks[0].collect()), n))
    schema = docs.schema

    def fn(batch: pa.RecordBatch) -> dict:
        keep, texts = [], []
        for text in batch.column(text_col).to_pylist():
            raw = (text or "").encode()
            n_words, spans, _ = shared.value.scan(raw)
            changed, hit = bool(spans), 0
            while spans and hit <= max_share * n_words:  # words that a cut brings together may be a window again
                hit += sum(b - a for a, b in spans)
                raw = cut_words(raw, spans)
                _, spans, _ = shared.value.scan(raw)
            keep.append(hit <= max_share * n_words)
            texts.append(raw.decode() if changed and keep[-1] else text)
        mask = pa.array(keep)
        columns = {f.name: batch.column(f.name) for f in schema}
        columns[text_col] = pa.array(texts, pa.string())
        return {k: v.filter(mask) for k, v in columns.items()}

    return map_batches(docs, fn, schema)


def _remove_in_rounds(docs: DataFrame, blocks: list[DataFrame], text_col: str, n: int, max_share: float) -> DataFrame:
    """The same over several blocks: a round scans the texts that the last one cut against every block, and cuts by all their hits."""
    rid = "_leak_row"
    while rid in docs.columns:
        rid += "_"
    rows = write_table(docs.withColumn(rid, F.monotonically_increasing_id()), "leak-docs").df
    now = rows.select(F.col(rid).alias("doc_id"), F.lit("").alias("digest"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("long").alias("hit"), F.lit(-1).cast("long").alias("n_words"))

    def fn(batch: pa.RecordBatch) -> dict:
        out: dict = {k: [] for k in ("text", "hit", "n_words")}
        for raw, spans, hit, n_words in zip(texts_of(batch, "text"), *(batch.column(k).to_pylist() for k in ("spans", "hit", "n_words")), strict=True):
            ranges = merged((s["a"], s["b"]) for s in spans)
            out["n_words"].append(len(item_words(raw)) if n_words < 0 else n_words)  # those of the whole text
            out["hit"].append(hit + sum(b - a for a, b in ranges))
            out["text"].append(cut_words(raw, ranges).decode())
        return out | {"doc_id": batch.column("doc_id"), "digest": batch.column("digest")}

    rounds: list[DataFrame] = []
    while True:
        found = reduce(DataFrame.unionByName, (_scan_keyed(now.select("doc_id", "digest", "text"), block, n) for block in blocks)).filter("size(spans) > 0")
        spans = write_table(found.groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans")), "leak-spans")
        if spans.df.isEmpty():
            break
        cut = write_table(map_batches(now.join(spans.joinable(), "doc_id"), fn, now.schema), "leak-cut").df
        rounds.append(cut.select(F.col("doc_id").alias("_at"), F.struct(F.lit(len(rounds)).alias("round"), (F.col("hit") > F.lit(max_share) * F.col("n_words")).alias("over"), "text").alias("cut")))
        now = cut.filter(F.col("hit") <= F.lit(max_share) * F.col("n_words"))
    if not rounds:
        return rows.drop(rid)
    last = write_table(reduce(DataFrame.unionByName, rounds).groupBy("_at").agg(F.max("cut").alias("_cut")), "leak-last").joinable()
    joined = rows.join(last, rows[rid] == last["_at"], "left").filter(last["_cut"].isNull() | ~last["_cut"]["over"])
    text = F.when(last["_cut"].isNull(), rows[text_col]).otherwise(last["_cut"]["text"])
    return joined.select(*(text.alias(c) if c == text_col else rows[c] for c in docs.columns))


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from a span's first word to its last; a line break marks each cut."""
    flat = text.translate(TABLE)
    starts, ends = [], []
    at = 0
    for w in flat.split():
        at = flat.index(w, at)
        starts.append(at)
        at += len(w)
        ends.append(at)
    out, done = [], 0
    for a, b in spans:
        out.append(text[done : starts[a]])
        done = ends[b - 1]
    return b"\n".join([*out, text[done:]])


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = hits(docs, items)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["b"] - s["a"])
    joined = F.concat_ws(",", "items")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
sized as (select item_id, w, least({WINDOW}, len(w)) as n from b where len(w) > 0),
grams as (
  select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as gram
  from sized, lateral (select unnest(range(1, len(w) - n + 2)) as i)
), sizes as (select distinct n from grams),
windows as (
  select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as gram
  from d cross join sizes, lateral (select unnest(range(1, len(w) - n + 2)) as i)
), hits as (
  select x.doc_id, x.n, x.i, g.item_id from windows x join grams g on x.n = g.n and x.gram = g.gram
), covered as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id
), found as (
  select doc_id, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct item_id::varchar)), ',') as items from hits group by doc_id
)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join found using (doc_id)
"""
