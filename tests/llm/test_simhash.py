import numpy as np
import pytest
import xxhash

from lodewell import runtime
from lodewell.llm import simhash


def slow_fingerprint(text: bytes) -> int:
    w = text.lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows, near=lambda a, b: bin(a ^ b).count("1") <= 2):
    """rows of (doc_id, fp): component id of each by comparing all pairs."""
    fps = [f for _, f in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if near(fps[i], fps[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    return [min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(rows))]


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    expected = [(d, slow_fingerprint((t or "").encode())) for d, t in rows]
    want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(expected, slow_components(expected), strict=True)), key=str)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.digest(df).collect()), key=str)
    assert got == want


def test_against_all_pairs(documents):
    check(documents)


def test_odd_rows(odd, empty, clashing):
    check(odd)
    check(clashing)
    assert simhash.digest(empty).collect() == []


@pytest.mark.parametrize("bucket", [2, 5, 64])
def test_links_of_dense_and_sparse_buckets(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)  # small ones are split by every segment
    rnd = np.random.default_rng(3)
    centre = rnd.integers(0, 1 << 63, dtype=np.uint64)
    fps = {int(centre)}
    while len(fps) < 400:  # many share most bits: buckets beyond the bound
        x = int(rnd.choice(np.array(list(fps), np.uint64)))
        for _ in range(rnd.integers(1, 4)):
            x ^= 1 << int(rnd.integers(0, 64))
        fps.add(x)
    fps |= {int(x) for x in rnd.integers(0, 1 << 63, 300, dtype=np.uint64)}
    values = sorted(fps)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    linked = [(r.u % (1 << 64), r.v % (1 << 64)) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()]
    assert all(bin(a ^ b).count("1") <= 2 for a, b in linked)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = slow_components([(i, v) for i, v in enumerate(values)])
    first = {}
    got = [first.setdefault(find(v), i) for i, v in enumerate(values)]
    assert got == want


def test_the_same_without_broadcasts(odd, monkeypatch):
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", -1)
    check(odd)


@pytest.mark.parametrize("few", [0, 10_000])
def test_components_of_stars_chains_and_loops(spark, monkeypatch, few):
    """Hot nodes, long chains and loops against plain union-find."""
    import random

    from lodewell.llm import components

    monkeypatch.setattr(components, "HOT_ROWS", 5)
    monkeypatch.setattr(components, "FEW", few)
    rnd = random.Random(4)
    edges = [(0, k) for k in range(1, 60)] + [(100 + k, 101 + k) for k in range(40)] + [(300, 301), (301, 302), (302, 300), (5, 5)] + [(rnd.randrange(400, 500), rnd.randrange(400, 500)) for _ in range(60)]
    rnd.shuffle(edges)
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).df.collect()}
    assert got == {x: find(x) for x in root}
