"""Best-fit packing by minimum bin slack over the histogram of piece lengths.

The plan needs only how many pieces have each length: at most ``capacity``
numbers, whatever the corpus size. For each bin the longest remaining length
is the seed, and a bitset subset-sum dynamic programme over the remaining
lengths (with their multiplicities) finds the fullest feasible rest. The
combination is removed as often as the counts allow, which is what repeating
the step bin by bin would do, so every step uses up at least one length and a
plan has at most ``capacity`` patterns.

Pieces then take their places without any global sort: a piece's rank among
those of its length is its salt's offset plus its rank within the salt, and
salts are as many as keep each group small. Rank, pattern and repetition give
sequence and offset.

Defined results: a null or empty text is the end token alone; repeated rows
are packed one by one; a null doc_id stays null; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import json
import os
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Table, write_table
from .common import id_text, map_batches, strings_of

CAPACITY = 1024
END_ID = 2
#: Pieces in one salted group, about; bounds the sort of one window task.
GROUP_ROWS = 1_000

_encoders: dict = {}


def vocabulary_path() -> str:
    """Ranks of the same vocabulary as byte_bpe_50k.json, in the form that the fast encoder reads; its added tokens are in the json beside."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    """A byte-level BPE encoder of the ranks at ``path`` and the added tokens of the json beside it, if any; one per worker process."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(path))
    return _encoders[path]


def added_tokens(path: str) -> dict[str, int]:
    """Tokens that the vocabulary's json adds to its ranks: they are cut out of a text wherever they stand in it."""
    beside = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(beside):
        return {}
    with open(beside, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens", [])
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
        raise ValueError("only added tokens that are matched literally are supported")
    return {t["content"]: t["id"] for t in added}


def token_ids(text: str, path: str) -> np.ndarray:
    """Little-endian unsigned 32-bit ids of a whole text, with the end id."""
    own = encoder(path)
    ids = own.encode(text, allowed_special="all") if any(t in text for t in own.special_tokens_set) else own.encode_ordinary(text)
    return np.append(np.asarray(ids, "<u4"), np.uint32(END_ID)).astype("<u4")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole, or full pieces after a first one that may be shorter."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and a row number that no two rows share once they are written."""
    path = vocabulary or vocabulary_path()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def fn(batch: pa.RecordBatch) -> dict:
        out: dict = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for doc, text in zip(batch.column("doc_id").to_pylist(), strings_of(batch, "text"), strict=True):
            ids = token_ids(text, path)
            for k, (start, length) in enumerate(cut(len(ids), capacity)):
                for name, value in zip(out, (doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes())), strict=True):
                    out[name].append(value)
        return out

    return map_batches(id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")), fn, schema).withColumn("row", F.monotonically_increasing_id())


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, with the largest sum up to ``room``.

    Bit s of a reach is set if a choice among the lengths so far sums to s;
    multiplicities go in as binary multiples, so a length costs log(room) shifts.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if counts[x] and x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:
            take = min(k, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left, k = left - take, k * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> pieces in a bin) and how many bins use each, by minimum bin slack."""
    left = {k: n for k, n in histogram.items() if n}
    out = []
    while left:
        seed = max(left)
        rest = dict(left)
        rest[seed] -= 1
        pattern = fullest(rest, capacity - seed)
        pattern[seed] = pattern.get(seed, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        out.append((pattern, times))
        for k, n in pattern.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def slots(patterns: Iterable[tuple[dict[int, int], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, runs of ranks in order: (first rank, pieces in a bin, first sequence, offset)."""
    used: dict[int, int] = {}
    out: dict[int, list] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            out.setdefault(length, []).append((used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return out


def pack(cut_pieces: Table, capacity: int = CAPACITY) -> DataFrame:
    """The written pieces with sequence_id and offset."""
    df = cut_pieces.df
    rows = {r["length"]: r["n"] for r in df.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    table = slots(plan(rows, capacity))
    # A length with many pieces is dealt to salts, so that no task orders more than about GROUP_ROWS of them. The salt
    # hangs on the written row number alone, so equal rows part and a task that runs again deals alike.
    salts = df.sparkSession.createDataFrame([(k, -(-n // GROUP_ROWS)) for k, n in rows.items()] or [(0, 1)], "length long, salts long")
    dealt = F.pmod(F.xxhash64("row"), F.col("salts"))
    salted = df.join(F.broadcast(salts), "length").withColumn("salt", dealt).drop("salts")
    ordered = Window.partitionBy("length", "salt").orderBy("row")
    ranked = salted.withColumn("rank", F.row_number().over(ordered) - F.lit(1))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "salt", "base")
    ranked = ranked.join(base, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def fn(batch: pa.RecordBatch) -> dict:
        out = {k: batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        where: list[int] = []
        offsets: list[int] = []
        for length, rank in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist(), strict=True):
            runs = table[length]
            first, n, sequence, offset = runs[bisect.bisect_right(runs, rank, key=lambda r: r[0]) - 1]
            where.append(sequence + (rank - first) // n)
            offsets.append(offset + (rank - first) % n * length)
        return out | {"sequence_id": where, "offset": offsets}

    return map_batches(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank")), fn, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Tokenise, cut and pack all documents into as few sequences as the method finds."""
    return pack(write_table(pieces(docs, id_col, text_col, capacity, vocabulary), "pieces"), capacity)
