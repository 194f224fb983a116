import functools
import random

import pytest
from pyspark.sql import functions as F

from lodewell.functions import bits, text
from lodewell.operators import classify, custody, diff, hierarchy, intervals, latest
from lodewell.operators.prefix import next_value, prefix_max, prefix_sum


@pytest.mark.parametrize("key_rows", [10**6, 10])
@pytest.mark.parametrize("inclusive", [True, False])
def test_prefix_max_whole_and_split(spark, key_rows, inclusive):
    rnd = random.Random(key_rows)
    rows = [(rnd.choice(["hot", "hot", "hot", "a", None]), i, rnd.choice([None, rnd.randrange(1000)])) for i in range(600)]
    rnd.shuffle(rows)
    got = {r.i: r.top for r in prefix_max(spark.createDataFrame(rows, "k string, i long, v long"), ["k"], ["i"], F.col("v"), "top", inclusive, key_rows).collect()}
    top = {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        before = top.get(k)
        if v is not None:
            top[k] = max(v, top.get(k, v))
        assert got[i] == (top.get(k) if inclusive else before)
    assert len(got) == 600


@pytest.mark.parametrize("key_rows", [10**6, 10])
def test_prefix_sum_and_next(spark, key_rows):
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot", "hot", "a"]), i * 3, rnd.randrange(-5, 6)) for i in range(400)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, v long")
    sums = {r.i: r.s for r in prefix_sum(df, ["k"], ["i"], F.col("v"), "s", True, key_rows).collect()}
    following = {r.i: r.n for r in next_value(df, ["k"], "i", "n", key_rows).collect()}
    for key in ("hot", "a"):
        mine = sorted((i, v) for k, i, v in rows if k == key)
        total = 0
        for n, (i, v) in enumerate(mine):
            total += v
            assert sums[i] == total and following[i] == (mine[n + 1][0] if n + 1 < len(mine) else None)


def test_intervals_with_split_keys(spark, monkeypatch):
    """The same algebra when every key is dealt to several blocks."""
    for name in ("prefix_max", "prefix_sum", "next_value"):
        monkeypatch.setattr(intervals, name, functools.partial(getattr(intervals, name), key_rows=3))
    rnd = random.Random(21)
    one, two = ranges(rnd, 60), ranges(rnd, 40)
    a, b = (spark.createDataFrame(x, "k string, start long, end long") for x in (one, two))
    for key in "xy":
        assert as_set(intervals.merge(a, ["k"]), key) == cells(one, key)
        assert as_set(intervals.subtract(a, b, ["k"]), key) == cells(one, key) - cells(two, key)


def ranges(rnd, n, span=300):
    out = []
    for _ in range(n):
        s = rnd.randrange(span)
        out.append((rnd.choice("xy"), s, s + rnd.randrange(0, 25)))
    return out


def cells(rows, key):
    return {c for k, s, e in rows if k == key for c in range(s, e)}


def as_set(df, key):
    return cells([tuple(r) for r in df.select("k", "start", "end").collect()], key)


def test_interval_algebra(spark):
    rnd = random.Random(7)
    for _ in range(3):
        one, two = ranges(rnd, 40), ranges(rnd, 30)
        a, b = (spark.createDataFrame(x, "k string, start long, end long") for x in (one, two))
        merged = intervals.merge(a, ["k"])
        for key in "xy":
            assert as_set(merged, key) == cells(one, key)
            assert as_set(intervals.subtract(a, b, ["k"]), key) == cells(one, key) - cells(two, key)
            assert as_set(intervals.intersect(a, b, ["k"]), key) == cells(one, key) & cells(two, key)
        rows = sorted(tuple(r) for r in merged.collect())
        assert all(k1 != k2 or e1 < s2 for (k1, _, e1), (k2, s2, _) in zip(rows, rows[1:], strict=False))
        wide = [("x", -50, 900), ("x", 3, 3), ("x", 64, 128), ("y", -7, -5), ("y", 1 << 60, (1 << 60) + 3)]
        more, others = one + wide, [*two, ("x", -(1 << 40), 1 << 61), ("y", -6, 70), ("y", (1 << 60) + 2, (1 << 60) + 9)]
        c, d = (spark.createDataFrame(x, "k string, start long, end long") for x in (more, others))
        for left, right, x, y in ((a, b, one, two), (c, d, more, others)):
            pairs = intervals.overlap_join(left.selectExpr("k", "start s", "end e"), right, ["k"], ("s", "e"), ("start", "end")).collect()
            want = sorted((k, s, e, s2, e2) for k, s, e in x for k2, s2, e2 in y if k == k2 and max(s, s2) < min(e, e2))
            assert sorted((r.k, r.s, r.e, r.start, r.end) for r in pairs) == want


def test_replay(spark):
    rnd = random.Random(11)
    log = [("v", q, rnd.choice(["alloc", "free"]), s, e) for q, (_, s, e) in enumerate(ranges(rnd, 200))]
    state = set()
    for _, _, kind, s, e in log:
        state = state | set(range(s, e)) if kind == "alloc" else state - set(range(s, e))
    got = intervals.replay(spark.createDataFrame(log, "k string, seq long, kind string, start long, end long"), ["k"], "seq", "kind")
    assert as_set(got, "v") == state


def test_replay_over_many_blocks(spark):
    """Entries that span whole blocks, among short ones; keys of very different sizes; the state after every position is the last writer's."""
    import numpy as np

    rnd = random.Random(17)
    log, size = [], 6000
    for q in range(3000):
        s = rnd.randrange(size)
        n = rnd.choice([1, 3, 10, 10, 200, 4000]) if q % 50 == 0 else rnd.randrange(1, 12)
        log.append((rnd.choice("aaaaaab"), q, rnd.choice(["alloc", "free"]), s, s + n))
    log += [("c", 0, "alloc", 5, 9), ("c", 1, "free", 9, 9), ("d", 0, "free", 0, 4)]
    df = spark.createDataFrame(log, "k string, seq long, kind string, start long, end long")
    got = intervals.replay(df, ["k"], "seq", "kind")
    for key in "abcd":
        state = np.zeros(size + 5000, bool)
        for k, _, kind, s, e in log:
            if k == key:
                state[s:e] = kind == "alloc"
        assert as_set(got, key) == set(np.flatnonzero(state).tolist()), key


def test_ranks_without_a_limit(spark):
    rows = [(i * 7919 % 1000, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "score long, k long")
    got = {r.k: r.id for r in classify.ranked_ids(df, [F.desc("score"), F.col("k")]).collect()}
    want = {k: f"c{n:04d}" for n, (_, k) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1)}
    assert got == want
    assert classify.ranked_ids(df.limit(0), [F.col("k")]).collect() == []


def test_margin_winner(spark):
    rows = [("a", 1, 9), ("a", 2, 4), ("a", 3, 4), ("b", 5, 8), ("b", 4, 8), ("c", 1, 7), ("d", 2, 20), ("d", 1, 11)]
    got = {r.k: (r.t, r.n, r.runner_up, r.clear) for r in classify.margin_winner(spark.createDataFrame(rows, "k string, t long, n long"), ["k"], "n", "t").collect()}
    assert got == {"a": (1, 9, 4, True), "b": (4, 8, 8, False), "c": (1, 7, 0, False), "d": (2, 20, 11, False)}


def test_remap_gap_is_an_error(spark):
    reads = spark.createDataFrame([(0, 1, 5, 10), (0, 2, 25, 10), (1, 3, 0, 5)], "vdev long, id long, off long, len long")
    mapping = spark.createDataFrame([(0, 0, 10, 1000), (0, 10, 20, 5000)], "vdev long, src long, len long, dst long")
    got = {}
    for r in intervals.remap(reads, mapping, ["vdev"], "id").collect():
        got.setdefault(r.id, (r.covered, []))[1].append((r.from_off, r.to_off, r.dst_off))
    assert got[1] == (True, got[1][1]) and sorted(got[1][1]) == [(5, 10, 1005), (10, 15, 5000)]
    assert not got[2][0] and not got[3][0]


def test_three_valued_overlap(spark):
    r = spark.createDataFrame([("a", 1, 0, 5), ("a", 2, 50, 60), ("b", 3, 0, 5), ("b", 4, 50, 60), ("c", 5, 0, 1)], "k string, id long, start long, end long")
    taken = spark.createDataFrame([("a", 4, 10), ("b", 0, 1)], "k string, start long, end long")
    known = spark.createDataFrame([("a", 0), ("b", 2)], "k string, bad long")
    got = {x.id: x.allocated for x in intervals.overlap_flag(r, taken, ["k"], "id", known, "bad").collect()}
    assert got == {1: True, 2: False, 3: True, 4: None, 5: None}


def test_as_of_join(spark):
    left = spark.createDataFrame([("a", 5, "l1"), ("a", 10, "l2"), ("b", 1, "l3"), (None, 3, "l4")], "k string, t long, name string")
    right = spark.createDataFrame([("a", 5, "r1"), ("a", 9, "r2"), ("a", 11, "r3"), (None, 2, "r4")], "k string, u long, tag string")
    got = {r.name: r.prev_tag for r in latest.as_of_join(left, right, ["k"], "t", "u", ["tag"]).collect()}
    assert got == {"l1": "r1", "l2": "r2", "l3": None, "l4": "r4"}


def test_newest_tie_sides(spark):
    df = spark.createDataFrame([(1, 7, 1, "first"), (1, 7, 2, "last"), (1, 3, 0, "old")], "k int, txg int, seq int, v string")
    assert latest.newest(df, ["k"], [F.col("txg"), -F.col("seq")]).first().v == "first"
    assert latest.newest(df, ["k"], [F.col("txg"), F.col("seq")]).first().v == "last"


def test_diff_of_nulls_and_versions(spark):
    before = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, f string")
    after = spark.createDataFrame([(2, None), (3, "d"), (4, None)], "k int, f string")
    assert {r.k: r.change for r in diff.full_diff(before, after, ["k"], ["f"]).collect()} == {1: "destroyed", 2: "same", 3: "changed", 4: "created"}


def test_version_events_with_null_facts(spark):
    states = spark.createDataFrame([(1, "a", None), (1, "b", "x"), (1, "d", "s"), (2, "a", None), (2, "b", None), (2, "c", "n"), (2, "d", "s"), (5, "c", "m"), (5, "a", "z")], "v int, k string, f string")
    versions = spark.createDataFrame([(1, 2), (2, 5), (5, None)], "v int, next int")
    got = sorted((r.v, r.k, r.kind, str(r.before), str(r.after)) for r in diff.version_events(states, "v", "k", "f", versions).collect())
    assert got == [(2, "b", "changed", "x", "None"), (2, "c", "created", "None", "n"), (5, "a", "changed", "None", "z"), (5, "b", "destroyed", "None", "None"), (5, "c", "changed", "n", "m"), (5, "d", "destroyed", "s", "None")]


def test_first_failure_and_misses(spark):
    df = spark.createDataFrame([(1, 9), (5, 1), (0, 0)], "a int, b int")
    checks = [("a_big", F.col("a") > 2), ("a_any", F.col("a") > 0), ("b_big", F.col("b") > 5)]
    got = [tuple(r) for r in df.select(classify.first_failure(checks), classify.misses(checks)).collect()]
    assert got == [("a_any", ["a_any", "b_big"]), ("a_big", ["a_big", "a_any"]), (None, [])]


def test_paths_stop_at_loops(spark):
    edges = spark.createDataFrame([("r", None, "root"), ("a", "r", "A"), ("b", "a", "B"), ("x", "y", "X"), ("y", "x", "Y")], "id string, parent string, name string")
    assert sorted((r.id, r.path, r.depth) for r in hierarchy.paths(edges, "id", "parent", "name").collect()) == [("a", "root/A", 1), ("b", "root/A/B", 2), ("r", "root", 0)]


def test_custody(spark):
    df = spark.createDataFrame([("p", 1, None), ("p", 2, "x"), ("p", 3, "y"), ("q", 1, "z"), ("q", 2, None)], "path string, seq int, h string")
    assert {r.path: (r.h, r.conflict) for r in custody.first_kept(df, ["path"], "h", "seq").collect()} == {"p": ("x", True), "q": ("z", False)}
    logs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, None), (3, None)], "log int, rec string")
    assert sorted((r.log, str(r.rec)) for r in custody.once_across_logs(logs, "log", ["rec"]).collect()) == [(1, "a"), (1, "a"), (2, "None")]


def test_scalars(spark):
    row = spark.range(1).select(
        bits.unsigned(F.lit(-1).cast("long")).alias("u"),
        bits.bits(F.lit(-1).cast("long"), 60, 4).alias("top"),
        bits.saturating_multiply(F.lit(1 << 62), F.lit(1 << 62)).alias("sat"),
        text.iso8601(F.lit(-1).cast("long")).alias("t"),
        text.hex_id(F.lit(-2).cast("long")).alias("h"),
        text.parse_time(F.lit("2026-02-30T00:00:00Z")).alias("bad"),
        text.parse_time(F.lit("1970-01-01T01:00:00+01:00")).alias("zero"),
        text.parse_time(F.lit("123")).alias("n"),
        text.mode_string(F.lit(0o40755)).alias("m"),
        text.visible(F.lit("a\x1b[2Jb")).alias("v"),
        text.guid_mixed(F.unhex(F.lit("33221100554477668899AABBCCDDEEFF"))).alias("g"),
    ).first()
    assert (int(row.u), row.top, row.sat, row.t, row.h, row.bad, row.zero, row.n, row.m, row.v, row.g) == ((1 << 64) - 1, 15, (1 << 63) - 1, "1969-12-31T23:59:59Z", "0xfffffffffffffffe", None, 0, 123, "drwxr-xr-x", "a�[2Jb", "00112233-4455-6677-8899-aabbccddeeff")
