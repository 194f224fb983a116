import bisect
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodewell.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def slow_pieces(rows, tokenizer):
    out = []
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            out.append((doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return sorted(out, key=str)


def check(df, tokenizer):
    got = packing.pack_documents(df).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == slow_pieces([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], tokenizer)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in got)
    return len(sequences), -(-total // 1024)


def test_round_trip(documents, odd, clashing, empty, tokenizer):
    n, least = check(documents, tokenizer)
    assert n <= 1.03 * least + 1
    check(odd, tokenizer)
    check(clashing, tokenizer)
    assert packing.pack_documents(empty).collect() == []


def test_salted_groups(documents, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 2)
    check(documents, tokenizer)


def test_ids_equal_the_tokenizers(tokenizer):
    rnd = random.Random(4)
    letters = "ab cD\n\t  é日ß'sll  \x85\x1c\x1f😀0123.,!<|endoftext|>ſ‍"
    for _ in range(3000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(50)))
        assert packing.token_ids(text, packing.vocabulary_path()).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_fullest_against_brute_force():
    rnd = random.Random(8)
    for _ in range(200):
        counts = Counter(rnd.choices(range(1, 20), k=rnd.randrange(1, 9)))
        room = rnd.randrange(0, 60)
        sums = {0}
        for length in counts.elements():
            sums |= {s + length for s in sums}
        chosen = packing.fullest(dict(counts), room)
        assert all(chosen[k] <= counts[k] for k in chosen)
        assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= room)


def test_plan_uses_every_piece_once():
    rnd = random.Random(2)
    lengths = Counter(rnd.choices(range(1, 1025), k=5000))
    plan = packing.plan(dict(lengths))
    used = Counter()
    for pattern, times in plan:
        assert sum(k * n for k, n in pattern.items()) <= 1024
        for k, n in pattern.items():
            used[k] += n * times
    assert used == lengths
    bins, volume = sum(t for _, t in plan), -(-sum(k * n for k, n in lengths.items()) // 1024)
    spaces: list[int] = []  # best fit decreasing, for comparison
    for length in sorted(lengths.elements(), reverse=True):
        k = bisect.bisect_left(spaces, length)
        left = (spaces.pop(k) if k < len(spaces) else 1024) - length
        bisect.insort(spaces, left)
    assert bins <= len(spaces) and bins <= volume * 1.015


def test_added_tokens_are_cut_out():
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(6)
    parts = ["<|endoftext|>", "<|endoftext", "|>", "<", " ", "\n\n", "word", " two words", "é日", "'s", "12"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>"] + ["".join(rnd.choices(parts, k=rnd.randrange(9))) for _ in range(2000)]
    assert packing.token_ids(texts[0], packing.vocabulary_path()).tolist() == [64, 220, 50256, 275, 2]
    for text in texts:
        assert packing.token_ids(text, packing.vocabulary_path()).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2], text


def test_equal_rows_part(spark, monkeypatch):
    """Many rows without id and text are dealt to many groups, and still fill their sequences without a gap."""
    monkeypatch.setattr(packing, "GROUP_ROWS", 50)
    df = spark.range(4000).selectExpr("cast(null as long) as doc_id", "cast(null as string) as text")
    written = packing.write_table(packing.pieces(df), "test-pieces")
    assert written.df.select("row").distinct().count() == 4000
    got = packing.pack(written).collect()
    assert sorted((r.sequence_id, r.offset) for r in got) == [(k // 1024, k % 1024) for k in range(4000)]
