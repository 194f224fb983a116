import random
import re
from collections import Counter, defaultdict

from lodewell import runtime
from lodewell.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_shape(text):
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {p for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def slow_verdicts(rows, min_docs, share):
    hosts, lines, docs = defaultdict(set), defaultdict(set), []
    for doc, host, text in rows:
        host, text = host or "", text or ""
        if doc is not None:
            hosts[host].add(doc)
        mine = Counter()
        for line in text.lower().split("\n"):
            w = WORD.findall(line)
            if len(w) >= 3:
                mine[" ".join(w)] += len(w)
        for line in mine:
            if doc is not None:
                lines[host, line].add(doc)
        docs.append((doc, host, text, mine))
    out = []
    for doc, host, text, mine in docs:
        gone = 0
        for line, n in mine.items():
            having = lines[host, line]
            if len(having) > max(min_docs, share * len(hosts[host])) and (doc is None or doc != min(having)):
                gone += n
        s = slow_shape(text)
        failed = s[0] < 20 or 100 * s[4] > 30 * s[0]
        out.append((doc, *s, gone, failed, not failed and gone <= rules.DEPLETED * s[0]))
    return sorted(out, key=str)


def check(df, **limits):
    rows = [(r.doc_id, r.source, r.text) for r in df.select("doc_id", "source", "text").collect()]
    want = slow_verdicts(rows, limits.get("min_docs", rules.MIN_DOCS), limits.get("share", rules.SHARE))
    got = sorted((tuple(r) for r in rules.verdicts(df, **limits).collect()), key=str)
    assert got == want
    return want


def test_verdicts(documents, odd, clashing, empty):
    found = check(documents, min_docs=2)
    assert any(r[6] for r in found)
    check(documents)
    for df in (odd, clashing):
        check(df, min_docs=1, share=0.0)
    assert rules.verdicts(empty).collect() == []


def test_rows_with_one_id_are_one_document(spark):
    """60 rows of 5 ids share a line: the host has five documents, all of them with the line."""
    rows = [(i % 5, f"one shared line of words\nown {i} words stay", "h") for i in range(60)]
    found = check(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_docs=4, share=0.5)
    assert sum(r[6] > 0 for r in found) == 48


def test_depleted_documents_go(spark):
    body = "one two three four five six seven eight nine ten"
    more = "red orange yellow green blue indigo violet black white grey brown pink teal cyan"
    rows = [(i, f"{body}\n{more}\nown {i} stays", "h") for i in range(12)]
    got = {r.doc_id: (r.removed_words, r.kept) for r in rules.verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_docs=5).collect()}
    assert got[0] == (0, True)
    assert all(not kept and removed == 24 for doc, (removed, kept) in got.items() if doc)


def test_repeated_words():
    rnd = random.Random(6)
    for _ in range(400):
        w = [rnd.choice("abcdefghij") for _ in range(rnd.randrange(0, 30))]
        for _ in range(rnd.randrange(3)):
            if w:
                a = rnd.randrange(len(w))
                w += w[a : a + rnd.randrange(12)]
        assert rules.repeated_words(w) == slow_shape(" ".join(w))[4]


def test_the_same_without_broadcasts(documents, monkeypatch):
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", -1)
    check(documents, min_docs=2)


def test_removed_lines_are_cut(spark, odd, empty):
    body = " ".join(f"word{k}" for k in range(30))
    shared = "All  of our Offers end this week"
    rows = [(k, f"{shared}\n{body} {k}\n\n  ALL of our offers\tend this week \nTwo words", "h") for k in range(25)]
    rows += [(100 + k, f"{shared}\n{body} {k}", "few") for k in range(5)] + [(200, "\n".join([shared] * 40 + ["own line here"]), "h"), (201, "short", "h"), (None, f"{shared}\n{body}", "h"), (3, f"{shared}\n{body} again", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as _rules_row", "doc_id as rid")
    out = rules.cleaned(df)
    assert out.columns == df.columns
    want = [(0, rows[0][1])] + [(k, f"{body} {k}\n\nTwo words") for k in range(1, 25)] + [(100 + k, f"{shared}\n{body} {k}") for k in range(5)] + [(None, body), (3, f"{body} again")]
    got = out.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)
    # The columns of op7 say the same of the documents before.
    lost = {(r.doc_id, r.n_words): r.removed_words for r in rules.digest(df).filter("kept").collect()}
    assert sum(lost.values()) == sum(len((t or "").split()) for d, t, _ in rows if d not in (200, 201)) - sum(len(r.text.split()) for r in got)
    assert rules.cleaned(odd).columns == odd.columns and rules.cleaned(empty).collect() == []
