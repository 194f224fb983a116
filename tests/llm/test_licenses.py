import functools
import random
import textwrap
from collections import Counter

from lodewell.llm import licenses as li
from lodewell.llm.decontaminate import item_words


@functools.lru_cache(maxsize=256)
def grams_of(w):
    return Counter(zip(w, w[1:], strict=False))


def dice(a, b):
    x, y = Counter(zip(a, a[1:], strict=False)), grams_of(tuple(b))
    return 2 * (x & y).total() / (x.total() + y.total()) if x and y else 0.0


def best_of(w, grams):
    """(-coefficient, template) of the template most alike, from the bigrams of all templates."""
    x = Counter(zip(w, w[1:], strict=False))
    n = x.total()
    return min((-2 * sum(min(c, y[g]) for g, c in x.items() if g in y) / (n + y.total()) if n and y else -0.0, k) for k, y in grams.items())


def slow_units(text, templates, threshold):
    """All lines, and the whole text, against all templates without any bound."""
    lines = [item_words(x) for x in text.encode().split(b"\n")]
    units = {(i, i): w for i, w in enumerate(lines)}
    if len(lines) > 1:
        units[0, len(lines) - 1] = [x for w in lines for x in w]
    grams = {k: grams_of(tuple(item_words(t.encode()))) for k, t in templates.items()}
    out = {}
    for at, w in units.items():
        found = best_of(w, grams)
        if -found[0] >= threshold:
            out[at] = (found[1], -found[0])
    return out


def slow_inside(line, templates, threshold):
    """The best of overlapping stretches of a line, each as long as the template that it is compared with."""
    w = item_words(line.encode())
    rated = []
    for k, t in templates.items():
        own = item_words(t.encode())
        for at in range(len(w) - len(own) + 1 if len(w) > len(own) else 0):
            score = dice(w[at : at + len(own)], own)
            if score >= threshold:
                rated.append((-score, -len(own), at, k))
    out = []
    for score, n, at, k in sorted(rated):
        if all(at - n <= a or b <= at for a, b, *_ in out):
            out.append((at, at - n, k, -score))
    return [(k, score) for _, _, k, score in sorted(out)]


def test_notices_inside_lines():
    """Any two templates one after the other in one line of prose, both found; against brute force."""
    scanner, rnd = li.Scanner(li.TEMPLATES), random.Random(8)
    names = sorted(k for k, t in li.TEMPLATES.items() if len(item_words(t.encode())) > 12)
    for a in names:
        b = rnd.choice(names)
        line = f"once upon a time there was {li.TEMPLATES[a]} and then it came that {li.TEMPLATES[b]} until the evening of the day " + "and so it went on " * 90
        found = [(k, s) for _, _, k, s in scanner.scan(line.encode())]
        assert found == slow_inside(line, li.TEMPLATES, li.THRESHOLD)
        assert (a, 1.0) in found and (b, 1.0) in found, (a, b, found)


def test_neighbouring_notices_are_both_found():
    scanner, rnd = li.Scanner(li.TEMPLATES), random.Random(9)
    names = sorted(k for k, t in li.TEMPLATES.items() if len(item_words(t.encode())) > 12)
    for a in names:
        b = rnd.choice(names)
        text = "\n\n".join("\n".join(textwrap.wrap(li.TEMPLATES[k], 70)) for k in (a, b))
        found = scanner.scan(f"int main of it\n\n{text}\n\n{'and so it went on ' * 90}".encode())
        assert [(k, s) for x, y, k, s in found if y > x] == [(a, 1.0), (b, 1.0)], (a, b, found)


def test_bounds_lose_nothing():
    scanner = li.Scanner(li.TEMPLATES)
    rnd = random.Random(5)
    pool = [w for t in li.TEMPLATES.values() for w in t.split()]
    for _ in range(1500):
        lines = []
        for _ in range(rnd.randrange(1, 4)):
            w = rnd.choice(list(li.TEMPLATES.values())).split()
            for _ in range(rnd.randrange(0, 3 + len(w) // 5)):
                k = rnd.randrange(len(w))
                w[k : k + rnd.randrange(2)] = [rnd.choice(pool)] * rnd.randrange(2)
                w = w or ["x"]
            lines.append(" ".join(w))
        text = "\n".join(lines)
        every = scanner.scan(text.encode())
        got = {(a, b): (k, s) for a, b, k, s in every}
        for at, found in slow_units(text, li.TEMPLATES, li.THRESHOLD).items():
            assert got[at] == found, (text, at)
        inner = {i for i, line in enumerate(lines) for j, b, *_ in every if i == j == b and dice(item_words(line.encode()), item_words(li.TEMPLATES[got[i, i][0]].encode())) < li.THRESHOLD}
        for i in inner:
            assert [(k, s) for a, b, k, s in every if a == b == i] == slow_inside(lines[i], li.TEMPLATES, li.THRESHOLD)
        for (a, b), (k, s) in got.items():
            if a == b and a in inner:
                continue
            w = [x for line in text.encode().split(b"\n")[a : b + 1] for x in item_words(line)]
            assert s >= li.THRESHOLD and abs(s - dice(w, item_words(li.TEMPLATES[k].encode()))) < 0.2


def test_wrapped_notice_is_found(spark):
    body = "\n".join(textwrap.wrap(li.TEMPLATES["mit"], 60))
    df = spark.createDataFrame([(1, f"Some program text here\n\n{body}\n\nint main of it"), (2, "Nothing of the sort."), (3, "All RIGHTS reserved")], "doc_id long, text string")
    got = {r.doc_id: r for r in li.digest(df).collect()}
    assert "mit" in got[1].licenses.split(",") and got[1].best_score == 1.0
    assert got[2].n_matches == 0 and got[2].best_score is None
    assert got[3].licenses == "all-rights-reserved"


def test_odd_rows(odd, clashing, empty):
    for df in (odd, clashing):
        assert li.digest(df).count() == df.count()
    assert li.digest(empty).collect() == []
    assert li.scan(odd, templates={}).filter("size(matches) > 0").count() == 0


def test_paragraphs_wrapped_at_any_width_are_found():
    scanner = li.Scanner(li.TEMPLATES)
    mit = li.TEMPLATES["mit"]
    cuts = [0, mit.index("The above copyright"), mit.index("THE SOFTWARE IS"), len(mit)]
    for width in range(20, 121):
        body = "\n\n".join("\n".join(textwrap.wrap(mit[a:b], width)) for a, b in zip(cuts, cuts[1:], strict=False))
        found = scanner.scan(f"Some program text here\n\n{body}\n\n{'int main of it' + ' and so on' * 60}".encode())
        assert [(a, b, s) for a, b, k, s in found if k == "mit"] == [(2, 2 + body.count("\n"), 1.0)], width


def slow_spans(text, templates, threshold):
    """The best of overlapping spans, and of lines and spans of each template, from all spans of lines and without any bound."""
    lines = [item_words(x) for x in text.encode().split(b"\n")]
    grams = {k: grams_of(tuple(item_words(t.encode()))) for k, t in templates.items()}
    rated = []
    for a in range(len(lines)):
        for b in range(a, len(lines)):
            if lines[a] and lines[b]:
                w = [x for line in lines[a : b + 1] for x in line]
                score, k = best_of(w, grams)
                if -score >= threshold:
                    rated.append((score, b - a, (a, b), k))
    out, taken, spanned = {}, {}, []
    for score, more, (a, b), k in sorted(rated):
        free = all(b < c or d < a for c, d in taken.get(k, []) + (spanned if more else []))
        if free:
            taken.setdefault(k, []).append((a, b))
            spanned += [(a, b)] if more else []
        if free or not more:
            out[a, b] = (k, -score)
    return out


def test_spans_against_brute_force():
    scanner = li.Scanner(li.TEMPLATES)
    rnd = random.Random(6)
    several = 0
    for _ in range(150):
        parts = []
        for _ in range(rnd.randrange(1, 4)):
            w = li.TEMPLATES[rnd.choice(["mpl-2.0", "gpl-3.0-line", "isc", "cc-by-4.0-line", "all-rights-reserved"])].split()
            for _ in range(rnd.randrange(0, 2 + len(w) // 12)):
                w[rnd.randrange(len(w))] = rnd.choice(["the", "other", "License", "of"])
            parts += textwrap.wrap(" ".join(w), rnd.randrange(12, 70)) + rnd.choice([[], [""], ["of the Software."], ["plain words between"]])
        text = "\n".join(parts)
        want = slow_spans(text, li.TEMPLATES, li.THRESHOLD) | slow_units(text, li.TEMPLATES, li.THRESHOLD)
        several += any(b > a for a, b in want)
        matched = {i for a, b in slow_spans(text, li.TEMPLATES, li.THRESHOLD) for i in range(a, b + 1)}
        inner = [(i, i, k, s) for i, line in enumerate(parts) if i not in matched for k, s in slow_inside(line, li.TEMPLATES, li.THRESHOLD)]
        assert scanner.scan(text.encode()) == sorted([*((a, b, k, s) for (a, b), (k, s) in want.items()), *inner], key=lambda x: x[:2]), text
    assert several > 100
