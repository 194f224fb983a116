import hashlib
from collections import defaultdict

import pytest

from lodewell import runtime
from lodewell.llm import linededup as ld


def normal(line):
    return line.strip(" \t\r\x0b\x0c").lower()


def slow(rows, sites, keep_first=True):
    """rows of (doc_id, site, text) -> cleaned texts, in order."""
    having, first = defaultdict(set), {}
    for doc, site, text in rows:
        for line in (text or "").split("\n"):
            n = normal(line)
            if n:
                having[n].add(site or "")
                if doc is not None:
                    first[n] = min(first.get(n, doc), doc)
    out = []
    for doc, _, text in rows:
        if text is None:
            out.append((doc, None))
            continue
        lines = [x for x in text.split("\n") if not (len(having.get(normal(x), ())) >= sites and not (keep_first and doc is not None and first.get(normal(x)) == doc))]
        out.append((doc, "\n".join(lines)))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep_first", [True, False])
@pytest.mark.parametrize("sites", [1, 3, 10])
def test_against_exact_counts(documents, sites, keep_first):
    rows = [(r.doc_id, r.source, r.text) for r in documents.collect()]
    cleaned, _ = ld.remove_boilerplate(documents, sites=sites, keep_first=keep_first)
    assert sorted(((r.doc_id, r.text) for r in cleaned.collect()), key=str) == slow(rows, sites, keep_first)


def test_every_spread_about_the_limit(spark):
    """Lines on 1 to 40 sites each: the sketches' verdicts equal exact counts on both sides of the limit."""
    rows, doc = [], 0
    for n in range(1, 41):
        for site in range(n):
            rows.append((doc, f"this line has {n} sites\nand its own line {doc} too", f"s{site}"))
            doc += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for sites in (2, 10, 25, 40):
        cleaned, _ = ld.remove_boilerplate(df, sites=sites)
        assert sorted(((r.doc_id, r.text) for r in cleaned.collect()), key=str) == slow([(d, s, t) for d, t, s in rows], sites)


def test_margin_covers_sketch_errors(spark):
    """Thousands of sites: far estimates decide, near ones are counted."""
    spread = {"near line below the limit": 2990, "near line at the limit": 3000, "far line well below it": 2000, "far line well above it": 4000}
    df = None
    for k, (line, n) in enumerate(spread.items()):
        part = spark.range(n).selectExpr(f"{k} * 100000L + id as doc_id", f"'{line}' as text", "concat('s', id) as source")
        df = part if df is None else df.unionByName(part)
    known = ld.boilerplate(ld.lines_table(df), 3000)
    assert known.df.count() == 2


def test_short_lines_and_scripts_without_spaces(spark):
    """One-word lines, tabs between words and lines without any space spread like others do."""
    lines = ["Home", "a\tb\tc", "這是一個沒有空格的樣板行", "two words", "three words here"]
    rows = [(i, "\n".join([*lines, f"own {i}"]), f"s{i}") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in ld.remove_boilerplate(df)[0].collect()}
    assert got == {i: t if i == 0 else f"own {i}" for i, t, _ in rows}


def test_lists_are_of_one_text(spark):
    """Many rows without an id, or with one id, have removal lists of their own lines only."""
    rows = [(None if i % 2 else 7, f"own line {i} of it\nshared by all of them", f"s{i % 12}") for i in range(200)] + [(1, "shared by all of them", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    cleaned, lost = ld.remove_boilerplate(df)
    assert lost.df.selectExpr("max(size(keys))").first()[0] == 1
    assert sorted(((r.doc_id, r.text) for r in cleaned.collect()), key=str) == slow([(d, s, t) for d, t, s in rows], ld.SITES)


def test_odd_rows(odd, clashing, empty):
    for df in (odd, clashing):
        rows = [(r.doc_id, r.source, r.text) for r in df.select("doc_id", "source", "text").collect()]
        cleaned, _ = ld.remove_boilerplate(df, sites=2)
        assert cleaned.columns == df.columns
        assert sorted(((r.doc_id, r.text) for r in cleaned.select("doc_id", "text").collect()), key=str) == slow(rows, 2)
        assert ld.dedup_documents(df).columns == df.columns
        assert ld.digest(df.select("doc_id", "text", "source")).count() == df.count()
    assert ld.digest(empty).collect() == [] and ld.dedup_documents(empty).collect() == []


def test_digest_and_emptied_documents(spark):
    rows = [(i, "an offer that never ends", f"s{i}") for i in range(12)] + [(50, "an offer that never ends\nbody text", "s1"), (51, "", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in ld.digest(df).collect()}
    assert (got[50].n_lines, got[50].n_kept, got[50].text_md5) == (2, 1, hashlib.md5(b"body text").hexdigest())
    assert got[0].n_kept == 1 and got[0].text_md5 == hashlib.md5(b"an offer that never ends").hexdigest()
    assert sorted(r.doc_id for r in ld.dedup_documents(df).collect()) == [0, 50, 51]


def test_no_python_on_the_main_path(documents):
    cleaned, _ = ld.remove_boilerplate(documents)
    plan = cleaned._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_the_same_without_broadcasts(documents, monkeypatch):
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", -1)
    rows = [(r.doc_id, r.source, r.text) for r in documents.collect()]
    cleaned, _ = ld.remove_boilerplate(documents, sites=3)
    assert sorted(((r.doc_id, r.text) for r in cleaned.collect()), key=str) == slow(rows, 3)
