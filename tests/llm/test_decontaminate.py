import hashlib
import random
import re

from lodewell.llm import decontaminate as dc
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def slow(rows, items):
    out = []
    for doc, text in rows:
        w = words(text)
        hit, found = set(), set()
        for item, item_text in items:
            iw = words(item_text)
            n = min(10, len(iw))
            for i in range(len(iw) - n + 1 if iw else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == iw[i : i + n]:
                        hit |= set(range(j, j + n))
                        found.add(str(item))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def items_and_docs(spark):
    rnd = random.Random(3)
    items = [(i, prose(rnd, rnd.randrange(1, 40))) for i in range(20)]
    items += [(20, None), (21, ""), (22, "..."), (23, "alpha beta gamma"), (24, "Lone"), (3, items[3][1]), (25, items[4][1])]
    docs = []
    for i in range(120):
        parts = [prose(rnd, rnd.randrange(0, 60))]
        if i % 3 == 0:
            w = (items[rnd.randrange(20)][1]).split(" ")
            a = rnd.randrange(len(w))
            parts.append("\n".join(w[a : a + rnd.randrange(1, 30)]).upper())
        if i % 7 == 0:
            parts.append("Alpha, beta; GAMMA!")
        if i % 11 == 0:
            parts.append(parts[-1])
        rnd.shuffle(parts)
        docs.append((i, " -- ".join(parts)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_against_brute_force(spark):
    docs, items = items_and_docs(spark)
    rows = [tuple(r) for r in docs.collect()]
    want = slow(rows, [tuple(r) for r in items.collect()])
    assert any(w[-1] for w in want) and not all(w[-1] for w in want)
    assert sorted((tuple(r) for r in dc.digest(docs, items).collect()), key=str) == want


def test_blocks_give_the_same(spark):
    docs, items = items_and_docs(spark)
    docs = docs.unionByName(docs.limit(5))
    one, many = (sorted((r.doc_id, r.n_words, str(r.spans), str(r.items)) for r in dc.hits(docs, items, max_bytes=m).collect()) for m in (1 << 20, 500))
    assert one == many


def test_odd_rows(spark, odd, clashing, empty):
    _, items = items_and_docs(spark)
    few = items.filter("item_id in (0, 20, 24)")
    for df in (odd, clashing):
        want = slow([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], [tuple(r) for r in few.collect()])
        assert sorted((tuple(r) for r in dc.digest(df, few).collect()), key=str) == want
        assert dc.remove_contaminated(df, few).columns == df.columns
    assert dc.digest(empty, items).collect() == []
    assert dc.digest(odd, items.limit(0)).filter("contaminated").count() == 0


def test_removal(spark):
    docs, items = items_and_docs(spark)
    kept = {r.doc_id: r.text for r in dc.remove_contaminated(docs, items).collect()}
    before = {r.doc_id: (r.n_hit, r.n_words) for r in dc.digest(docs, items).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    after = dc.digest(dc.remove_contaminated(docs, items), items)
    assert after.filter("contaminated").count() == 0
    for doc, (hit, n) in before.items():
        if not hit:
            assert kept[doc] == texts[doc]
        elif doc in kept:
            assert hit <= 0.2 * n and len(words(kept[doc])) <= n - hit
        else:
            assert hit > 0


def test_removal_in_blocks_is_the_same(spark):
    docs, items = items_and_docs(spark)
    rnd = random.Random(8)
    own = [" ".join(f"{name}{k}" for k in range(10)) for name in ("left", "right", "outer")]
    items = items.unionByName(spark.createDataFrame(list(enumerate(own, 100)), "item_id long, text string"))
    outer = own[2].split(" ")
    extra = [
        (1000, f"{own[0]} {prose(rnd, 45)} {own[1]}"),  # 20 of 65 words by two items
        (1001, f"{' '.join(outer[:5])} {own[0]} {' '.join(outer[5:])} {prose(rnd, 120)}"),  # a window after the cut
        (None, f"{own[1]} {prose(rnd, 90)}"),
        (None, None),
    ]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).unionByName(docs.limit(4)).selectExpr("doc_id", "text", "doc_id as _leak_row", "length(text) as hit")
    one, many = (sorted(map(tuple, dc.remove_contaminated(docs, items, max_bytes=m).collect()), key=str) for m in (1 << 20, 150))
    assert len(dc._blocks(items, "item_id", "text", 150)) > 3
    assert one == many
    kept = {r[0]: r[1] for r in many}
    assert 1000 not in kept and not set(words(kept[1001])) & set(outer)


def test_items_without_id_hit(spark):
    passage = " ".join(f"secret{k}" for k in range(10))
    items = spark.createDataFrame([(None, passage), (7, "Known words"), (None, "Known words")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before {passage} " + "after " * 60), (2, "some known words here"), (3, "nothing")], "doc_id long, text string")
    for m in (1 << 20, 40):
        found = {r.doc_id: (sum(s.b - s.a for s in r.spans), list(r["items"])) for r in dc.hits(docs, items, max_bytes=m).collect()}
        assert found == {1: (10, []), 2: (2, ["7"]), 3: (0, [])}
        assert "secret" not in {r.doc_id: r.text for r in dc.remove_contaminated(docs, items, max_bytes=m).collect()}[1]
