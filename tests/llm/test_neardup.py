import random

import numpy as np
import pytest

from lodewell import runtime
from lodewell.llm import neardup, simhash
from tests.llm.conftest import prose


def slow_set(text, size=neardup.SHINGLE):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def slow_groups(rows, similarity=neardup.SIMILARITY):
    """rows of (doc_id, text): {doc_id: least id of its group}, by comparing all pairs; rows without an id are left out."""
    rows = [(d, slow_set(t)) for d, t in rows if d is not None]
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, s) in enumerate(rows):
        for b, t in rows[:i]:
            if s == t or len(s & t) >= similarity * len(s | t):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d in root}


def check(df):
    want = slow_groups([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    got = neardup.groups(df).df.collect()
    assert len(got) == len(want) and {r.doc_id: r.group_id for r in got} == want
    return want


def edited(rnd, text, words):
    w = text.split(" ")
    for _ in range(words):
        w[rnd.randrange(len(w))] = f"other{rnd.randrange(10**6)}"
    return " ".join(w)


def test_against_all_pairs(spark, documents, odd, clashing):
    for df in (documents, odd, clashing, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        check(df)


def test_empty(empty):
    assert neardup.groups(empty).df.collect() == [] and simhash.near_dedup(empty).collect() == []


def test_similarities_about_the_limit(spark):
    """Copies of 300 words with 1 to 12 words changed lie on both sides of 0.8."""
    rnd, rows = random.Random(12), []
    for k in range(60):
        text = prose(rnd, 300)
        rows += [(2 * k, text), (2 * k + 1, edited(rnd, text, 1 + k % 12))]
    found = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert 20 < sum(found[2 * k + 1] == 2 * k for k in range(60)) < 50


def test_short_texts(spark):
    rnd, rows = random.Random(13), []
    for k in range(80):
        w = prose(rnd, rnd.randrange(4, 16)).split(" ")
        rows += [(3 * k, " ".join(w)), (3 * k + 1, " ".join([*w, "more"])), (3 * k + 2, " ".join(w[:-1]))]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.mark.parametrize("bucket", [2, 8])
def test_large_families_and_shared_passages(spark, monkeypatch, bucket):
    """Buckets over the bound: a family of near copies, and texts that are strangers but for a long passage."""
    monkeypatch.setattr(neardup, "BUCKET", bucket)
    rnd = random.Random(14)
    base, passage = prose(rnd, 200), prose(rnd, 120)
    rows = [(i, edited(rnd, base, rnd.randrange(0, 4))) for i in range(120)]
    rows += [(1000 + 2 * i + k, passage + " " + own) for i in range(40) for own in [prose(rnd, 60)] for k, own in enumerate((own, edited(rnd, own, 2)))]
    found = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {found[i] for i in range(120)} == {0}


def test_one_of_each_group_stays(documents, odd):
    for df in (documents, odd):
        kept = simhash.near_dedup(df)
        assert kept.columns == df.columns
        groups = slow_groups([(r.doc_id, r.text) for r in df.collect()])
        ids = [r.doc_id for r in kept.collect()]
        named = [i for i in ids if i is not None]
        assert len(named) == len(set(named)) and set(named) == set(groups.values())
        assert ids.count(None) == df.filter("doc_id is null").count()


def test_the_same_without_broadcasts(odd, monkeypatch):
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", -1)
    check(odd)
    assert simhash.near_dedup(odd).count() == len(set(check(odd).values())) + 2


def test_pruning_loses_no_near_pair():
    """Whatever passes the full check within the bound has a chain from some start, so the ring prunes none of it."""
    rnd = np.random.default_rng(2)
    base = rnd.integers(0, 1 << 63, 4, np.uint64)
    fps = np.array([base ^ np.packbits(rnd.random((4, 64)) < p, axis=1, bitorder="little").view(np.uint64)[:, 0] for p in rnd.uniform(0, 0.3, 200)])
    a, b, bits = neardup.prune(np.full(200, 9), fps, 0.8)
    i, j = np.triu_indices(200, 1)
    apart = np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1)
    near = apart <= neardup.DISTANCE
    assert np.array_equal(a, i[near]) and np.array_equal(b, j[near]) and np.array_equal(bits, apart[near]) and 0 < near.sum() < len(near)


def passage_rows(seed, pairs):
    """Texts of about 0.77 to all others by a long common passage, each with one partner of about 0.85."""
    rnd, rows = random.Random(seed), []
    passage = prose(rnd, 250)
    for k in range(pairs):
        own = prose(rnd, 38)
        rows += [(2 * k, passage + " " + own), (2 * k + 1, passage + " " + edited(rnd, own, 3))]
    return rows


@pytest.mark.parametrize("block", [512, 16])
def test_partners_in_buckets_that_nothing_parts(spark, monkeypatch, block):
    """Nodes whose least values all lie in a passage that hundreds share meet their partner in large buckets only."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    found = check(spark.createDataFrame(passage_rows(15, 150), "doc_id long, text string"))
    assert sum(found[2 * k + 1] == 2 * k for k in range(150)) > 100


def test_large_components_have_blocks_of_their_own(spark, monkeypatch):
    """A family that is one component already, beside strangers and their partners."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rnd, rows = random.Random(16), passage_rows(16, 60)
    rows += [(1000 + i, edited(rnd, rows[0][1], 1)) for i in range(150)]
    assert len(set(check(spark.createDataFrame(rows, "doc_id long, text string")).values())) > 50


def test_blocks_against_all_pairs():
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 1 << 63, 40, np.uint64)
    own = [np.unique(np.concatenate([rnd.choice(base, rnd.integers(20, 41), replace=False), rnd.integers(0, 1 << 63, 2, np.uint64)])) for _ in range(60)]
    root, keys = rnd.integers(0, 45, 60), rnd.integers(0, 4, (60, neardup.PAIRS))
    for table in (0, 1, 3):
        for first, second in ((np.arange(60),) * 2, (np.arange(25), np.arange(25, 60))):
            both = [(i, j) for i in first for j in second if i < j and (keys[i, :table] != keys[j, :table]).all()]
            want = {(root[i], root[j]) for i, j in both if root[i] != root[j] and len(np.intersect1d(own[i], own[j])) >= 0.8 * len(np.union1d(own[i], own[j]))}
            u, v = neardup.compared(table, root, keys, own, first, second, 0.8)
            assert u and {tuple(sorted(p)) for p in zip(u, v)} <= {tuple(sorted(p)) for p in want}

            def joined(edges):
                top = {x: x for x in range(45)}
                for a, b in edges:
                    old, new = sorted((top[a], top[b]), reverse=True)
                    top = {x: new if t == old else t for x, t in top.items()}
                return top

            assert joined(zip(u, v)) == joined(want) and len(u) < 45
