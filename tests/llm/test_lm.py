import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodewell.llm import lm

SMALL = {"head_words": 60, "core_words": 20, "classes": 8}


def slow(rows):
    train = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2 for d, _ in rows]
    tokens = [(t or "").encode().lower().split() + [b""] for _, t in rows]
    counts = Counter(w for own, yes in zip(tokens, train, strict=True) if yes for w in own)
    n, v = sum(counts.values()), len(counts)
    return sorted(((d, not yes, len(own), sum(counts[w] > 0 for w in own), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), 5)) for (d, _), own, yes in zip(rows, tokens, train, strict=True)), key=str)


@pytest.mark.parametrize("sizes", [SMALL, {}])
def test_base_columns(documents, odd, clashing, sizes):
    for df in (documents, odd, clashing):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in lm.digest(df, **sizes).collect()), key=str)
        assert [g[:5] for g in got] == [w[:5] for w in slow(rows)]
        assert np.allclose([g[5] for g in got], [w[5] for w in slow(rows)], atol=1e-4)


def test_empty(empty):
    assert lm.digest(empty, **SMALL).collect() == []


def test_model_is_a_distribution(spark, documents):
    """Class transitions sum to one, and so do each class's emissions with the share of expected unseen words."""
    df = documents.selectExpr("doc_id", "true as train", "text")
    model, tail, _ = lm.train_model(df, **SMALL)
    assert np.allclose((10**model.transition).sum(1), 1)
    emission, _ = model.numbered()
    per_class = Counter({0: 10 ** emission[lm.END]})
    for k in range(lm.FIRST, len(model.classes)):
        per_class[int(model.classes[k])] += 10 ** emission[k]
    counts = Counter(w for r in documents.collect() for w in (r.text or "").encode().lower().split())
    rows = tail.df.collect()
    assert {r.word.encode(): r.c for r in rows} == {w: c for w, c in counts.items() if w not in model.head.lookup()}
    for r in rows:
        assert (r["class"] == lm.RARE) == (r.c == 1)
        per_class[r["class"]] += 10 ** float(model.emission(np.array([r.c]), np.array([r["class"]]))[0])
    once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
    per_class[lm.RARE] += 10**model.unknown * max(1, once * once / (2 * max(1, twice)))
    assert all(abs(x - 1) < 1e-9 for x in per_class.values()), per_class


def test_score_by_hand(documents):
    df = documents.selectExpr("doc_id", "doc_id % 7 <> 2 as train", "text")
    model, tail, rows = lm.train_model(df, **SMALL)
    numbers, emission = model.head.lookup(), model.numbered()[0]
    rest = {r.word.encode(): (r.c, r["class"]) for r in tail.df.collect()}
    texts = {r.doc_id: r.text for r in documents.collect()}
    pairs = np.zeros((8, 8))
    for r in documents.collect():
        before = 0
        for w in r.text.encode().lower().split() + [b""]:
            c = lm.END if w == b"" else model.classes[numbers[w]] if w in numbers else rest.get(w, (0, lm.RARE))[1]
            pairs[before, c] += r.doc_id % 7 != 2
            before = c
    unigram = (pairs.sum(0) + 1) / (pairs.sum() + 8)
    assert np.allclose(model.transition, np.log10((pairs + lm.PRIOR * unigram) / (pairs.sum(1, keepdims=True) + lm.PRIOR)))
    for r in lm.score(rows, model).collect():
        before, want = 0, 0.0
        for w in texts[r.doc_id].encode().lower().split() + [b""]:
            if w == b"" or w in numbers:
                k = lm.END if w == b"" else numbers[w]
                c = model.classes[k]
                want += emission[k]
            else:
                n, c = rest.get(w, (0, lm.RARE))
                want += math.log10(n / model.in_class[c]) if n else model.unknown
            want += model.transition[before, c]
            before = c
        assert abs(r.score - want) < 1e-6
        assert abs(r.perplexity - 10 ** (-want / r.n_tokens)) < 1e-6 * r.perplexity


def test_every_word_met_twice_is_placed(documents):
    """Whatever the number of numbered words, only words met once are rare."""
    df = documents.selectExpr("doc_id", "true as train", "text")
    for sizes in (SMALL, {"head_words": 5, "core_words": 5, "classes": 6}, {}):
        model, tail, _ = lm.train_model(df, **sizes)
        assert (model.classes[lm.FIRST :] > lm.RARE + 1).all()
        assert tail.df.filter(f"c > 1 and class <= {lm.RARE + 1}").count() == 0


def test_best_classes_gain_most():
    """Against the plain gain of each word in each class; a word in its class is taken out of the table first."""
    rnd = np.random.default_rng(5)
    table = rnd.integers(20, 60, (7, 7))
    words, old = [], rnd.integers(3, 7, 50)
    for _ in range(50):
        both = rnd.integers(0, 4, 14) * (rnd.random(14) < 0.4)
        both[rnd.integers(0, 14)] += 1
        words.append(both)
    starts = np.cumsum([0, *(np.count_nonzero(w) for w in words)])[:-1]
    cell = np.concatenate([np.flatnonzero(w) for w in words])
    n = np.concatenate([w[w > 0] for w in words])
    new = lm.best_classes(table, 3, starts, cell, n)
    for w, c in zip(words, new, strict=True):
        gain = lm.gains(table, w[:7], w[7:])[3:]
        assert gain[c - 3] >= gain.max() - 1e-9
    stay = lm.best_classes(table, 3, starts, cell, n, old)
    for w, o, c in zip(words, old, stay, strict=True):
        out = table.copy()
        out[o] -= w[7:]
        out[:, o] -= w[:7]
        full = lm.gains(table, w[:7], w[7:])
        full[o] = 0.0  # what the class loses without the word, with no pair of the word counted twice
        for g, k in enumerate(w[7:]):
            full[o] += lm._xlogx(table[o, g]) - lm._xlogx(table[o, g] - k)
        for g, k in enumerate(w[:7]):
            full[o] += lm._xlogx(table[g, o]) - lm._xlogx(table[g, o] - k)
        full[o] -= lm._xlogx(table[o].sum()) - lm._xlogx(table[o].sum() - w[7:].sum())
        full[o] -= lm._xlogx(table[:, o].sum()) - lm._xlogx(table[:, o].sum() - w[:7].sum())
        assert full[c] >= full[3:].max() - 1e-9


def test_exchange_raises_the_likelihood():
    rnd = np.random.default_rng(1)
    hidden = rnd.integers(0, 3, 40)
    pairs = rnd.poisson(np.where((hidden[:, None] + 1) % 3 == hidden[None, :], 9.0, 0.2))
    pairs = np.pad(pairs, ((3, 0), (3, 0)))

    def likelihood(of):
        table = np.zeros((6, 6))
        np.add.at(table, (of[:, None], of[None, :]), pairs)
        return lm._xlogx(table).sum() - lm._xlogx(table.sum(0)).sum() - lm._xlogx(table.sum(1)).sum()

    of = lm.exchange(pairs, 3, 6, sweeps=10)
    start = np.array([s if s < 3 else 3 + (s - 3) % 3 for s in range(43)])
    assert likelihood(of) > likelihood(start)
    assert all(len(set(of[3:][hidden == h])) == 1 for h in range(3))


def test_held_out_text(spark):
    """Held-out text scores better than with the unigram, and worse than training text does."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.held_out: r for r in lm.digest(df).groupBy("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).collect()}
    assert rows[True].s > rows[True].b
    assert rows[True].s / rows[True].n < rows[False].s / rows[False].n
