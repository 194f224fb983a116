"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

One pass finds candidates: the four base kinds by their fixed patterns, and
wider patterns (spelled-out addresses, national phone forms, digit groups that
failed a base check, identity numbers, credentials). Five labelers vote on
each: the form (a regular expression or checksum), a gazetteer, the words
before it, its surroundings, and its variety of characters. The candidate's
votes and discrete features make a pattern.

Expectation-maximisation over the counts of distinct patterns (their number is
bounded by the votes and features, whatever the corpus) estimates, for each
kind, how often each labeler votes for and against what is personal data and
what is not. Two ends are held: base spans are personal data by definition, and
a card number or address that fails its check, with no word for it before it,
is none. A logistic span classifier is trained on the resulting probabilities. Candidates
that it accepts are added where they overlap no other span. Base spans always
stay.

Defined results: null and empty texts have no spans; repeated rows are
reported one by one; a null doc_id stays null; an empty table gives an empty
result; further columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import write_table
from .common import id_text, map_batches, strings_of

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds, after the base kinds in the order of output.
KINDS = (*BASE_KINDS, "id_number", "secret")
LABELERS = 5
ROUNDS = 50

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# Each run of digits is tried from its first digit only: a later start fails where the first does.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY_DIGIT = re.compile(r"[0-9]")

_SPELLED = re.compile(r"\b[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{2,63}){1,4}\b")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z+])(?:\([0-9]{2,4}\)[ -]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])")
_IDENTITY = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
_CREDENTIAL = re.compile(r"(?:\bAKIA[0-9A-Z]{16}\b)|(?:\b(?:password|passwd|secret|token|api_?key) ?[=:] ?\"?[A-Za-z0-9+/_-]{8,128}\"?)", re.IGNORECASE)

# Gazetteers (fixed values): top-level domains, card issuer digits, calling codes, credential names.
TOP_LEVEL = frozenset(
    "at au be biz br ca ch cn co com cz de dev dk edu es eu fi fr gov gr hu id ie il in info int io it jp kr me mil mx name net nl no nz org "
    "pl pt ro ru se sg sk th tr tv tw ua uk us za".split()
)
ISSUERS = ("4", "51", "52", "53", "54", "55", "2221", "34", "37", "6011", "65", "35", "36")
CALLING = ("1", "7", "20", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91")
NAMED = ("akia", "password", "passwd", "secret", "token", "api")
CONTEXT = {
    "email": ("mail", "contact", "write", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "credit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "call", "tel", "fax", "mobile", "ruf", "llam", "appel"),
    "id_number": ("ssn", "social", "security", "id", "passport"),
    "secret": ("key", "login", "credential", "auth", "pass"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards: linear in the text."""
    out: list[tuple[int, int]] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and _LOCAL.match(text, start - 1):
            start -= 1
        # Characters of a domain may begin the next address, those before this @ may not: it is no local character.
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The fixed patterns with their checks; a match that fails its check is dropped."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE_KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if _ANY_DIGIT.search(text):
        if "." in text:
            out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        out["card"] = [m.span() for m in _DIGITS.finditer(text) if 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d)]
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind number, start, end, base) of all candidates, sorted; wider ones overlap no base span."""
    base = base_spans(text)
    found = [(KINDS.index(k), a, b, True) for k, spans in base.items() for a, b in spans]
    wide: list[tuple[int, int, int]] = []
    if "at" in text and ("dot" in text or "(at)" in text or "[at]" in text):
        wide += [(0, *m.span()) for m in _SPELLED.finditer(text)]
    if _ANY_DIGIT.search(text):
        wide += [(3, *m.span()) for m in _NATIONAL.finditer(text)]
        wide += [(4, *m.span()) for m in _IDENTITY.finditer(text)]
        wide += [(2, *m.span()) for m in _DIGITS.finditer(text) if 13 <= sum(c.isdigit() for c in m[0]) <= 19]
        wide += [(1, *m.span()) for m in _IP.finditer(text)]
        wide += [(3, *m.span()) for m in _PHONE.finditer(text)]
    lowered = text.lower()
    if "akia" in lowered or any(w in lowered for w in NAMED[1:]):
        wide += [(5, *m.span()) for m in _CREDENTIAL.finditer(text)]
    taken = Taken((a, b) for _, a, b, _ in found)
    found += [(k, a, b, False) for k, a, b in sorted(set(wide)) if taken.free(a, b)]
    return sorted(found)


class Taken:
    """Stretches of a text that spans take; overlapping ones are merged, so one look finds any overlap."""

    def __init__(self, spans: Iterable[tuple[int, int]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        i = bisect.bisect_left(self.starts, b)
        return not i or self.ends[i - 1] <= a

    def add(self, a: int, b: int) -> None:
        """Take a stretch that is free."""
        i = bisect.bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def votes(text: str, kind: int, start: int, end: int, base: bool) -> tuple[int, ...]:
    """Each labeler's vote: 1 personal, -1 not, 0 abstains."""
    name, span = KINDS[kind], text[start:end]
    digits = "".join(c for c in span if c.isdigit() and c.isascii())
    if name == "card":
        form = 1 if luhn(digits) and len(digits) >= 15 else -1
        known = 1 if digits.startswith(ISSUERS) else -1
    elif name == "ip":
        parts = [int(p[-4:]) for p in span.split(".")]
        form = 1 if max(parts) <= 255 else -1
        known = -1 if parts[0] in (0, 127) or parts[0] >= 224 else 1
    elif name == "phone":
        form = 1 if 8 <= len(digits) <= 15 and (span[0] in "+(" or "-" in span) else -1  # groups between spaces or dots alone are any numbers
        known = (1 if digits.startswith(CALLING) else -1) if span.startswith("+") else (1 if "555" in span or span.startswith("(") else 0)
    elif name == "email":
        form = 1 if base else 0
        known = 1 if re.split(r"[^A-Za-z0-9-]+", span)[-1].lower() in TOP_LEVEL else -1
    elif name == "id_number":
        form = 1 if digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000" else -1
        known = 0
    else:
        form = 1 if span[:4].upper() == "AKIA" or any(c.isdigit() for c in span) else -1
        known = 1 if span.lower().startswith(NAMED) else 0
    before = text[max(0, start - 40) : start].lower()
    context = 1 if any(w in before for w in CONTEXT[name]) else 0
    # The last two only ever speak against: nearly everything stands free and varies.
    edge = -1 if (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()) else 0
    variety = len(set(digits if name in ("card", "phone", "id_number") else span))
    varied = 0 if variety >= 4 else -1
    return form, known, context, edge, varied


def pattern(text: str, kind: int, start: int, end: int, base: bool) -> int:
    """Votes, kind and discrete features of a candidate in one number."""
    code = kind
    for v in votes(text, kind, start, end, base):
        code = code * 3 + v + 1
    digits = sum(c.isdigit() for c in text[start:end])
    return (code * 4 + min(3, digits // 5)) * 2 + int(base)


def unpack(code: int) -> tuple[int, list[int], int, int]:
    """(kind, votes, digit class, base) of a pattern."""
    code, base = divmod(code, 2)
    code, size = divmod(code, 4)
    out = []
    for _ in range(LABELERS):
        code, v = divmod(code, 3)
        out.append(v - 1)
    return code, out[::-1], size, base


#: What the rates begin as, and how many candidates that belief is worth: a labeler mostly speaks for personal data, seldom against it, and the other way round.
FOR, AGAINST, STRENGTH = 0.8, 0.1, 20.0


def anchor(kind: int, v: Iterable[int], base: int) -> float:
    """1 for what is personal data for certain, 0 for what is not, NaN for what is to be found out."""
    form, _, context, *_ = v
    return 1.0 if base else 0.0 if KINDS[kind] in ("card", "ip") and form < 0 and context <= 0 else np.nan


def reliabilities(kind: np.ndarray, v: np.ndarray, n: np.ndarray, held: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """EM for a two-class naive Bayes of labelers: (probability of each pattern, rates[kind, class, labeler]).

    ``v`` holds votes of distinct patterns, ``n`` their counts, ``held`` the
    probabilities that are certain, else NaN. A rate is the share of a labeler's
    votes for, among its votes on what is (class 1) or isn't (0) personal data;
    an abstention says nothing. A labeler that only ever speaks on one side is
    judged by how often it speaks.
    """
    kinds = int(kind.max(initial=-1)) + 1
    start = np.array([AGAINST, FOR])[None, :, None] * np.ones((kinds, 2, v.shape[1]))
    rates, prior = start.copy(), np.full(kinds, 0.5)
    one_sided = np.array([[not ((v[kind == k] > 0).any(axis=0) & (v[kind == k] < 0).any(axis=0))[j] for j in range(v.shape[1])] for k in range(kinds)]).reshape(kinds, -1)
    p, open_ = np.where(np.isnan(held), 0.5, held), held != 1.0
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior))[kind]
        for vote in (1, -1):
            say = rates if vote > 0 else 1 - rates
            odds = odds + np.where(v == vote, np.log(say[kind, 1] / say[kind, 0]), 0.0).sum(axis=1)
        p = np.where(np.isnan(held), 1 / (1 + np.exp(-np.clip(odds, -30, 30))), held)
        for k in range(kinds):
            mine = kind == k
            for c, share in ((0, 1 - p), (1, p)):
                weight = (n * share)[mine][:, None]
                yes, cast = (weight * (v[mine] > 0)).sum(0), (weight * (v[mine] != 0)).sum(0)
                rates[k, c] = np.where(one_sided[k], start[k, c], (yes + STRENGTH * start[k, c]) / (cast + STRENGTH))
            asked = mine & open_  # base spans don't make the others likelier
            prior[k] = np.clip((n[asked] @ p[asked] + 1) / (n[asked].sum() + 2), 0.05, 0.95)
    return p, rates


def _inputs(codes: Iterable[int]) -> np.ndarray:
    """A row for each pattern: each kind's intercept and votes, and the class of digits."""
    rows = []
    for code in codes:
        kind, v, size, _ = unpack(code)
        row = np.zeros((len(KINDS), 1 + LABELERS))
        row[kind] = [1.0, *v]
        rows.append([*row.ravel(), *(float(size == s) for s in range(4))])
    return np.array(rows, float).reshape(-1, len(KINDS) * (1 + LABELERS) + 4)


def train(counts: dict[int, int]) -> dict[int, float]:
    """The classifier's probability of every pattern, trained on the labelers' agreement."""
    if not counts:
        return {}
    codes = sorted(counts)
    n = np.array([counts[c] for c in codes], float)
    parts = [unpack(c) for c in codes]
    p, _ = reliabilities(np.array([k for k, *_ in parts]), np.array([v for _, v, _, _ in parts]), n, np.array([anchor(k, v, base) for k, v, _, base in parts]))
    x = _inputs(codes)
    w = np.zeros(x.shape[1])
    weight = n / n.sum() * min(n.sum(), 1e4)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (p - q)) - 0.1 * w)
        w += step / max(1.0, np.abs(step).max())
    return dict(zip(codes, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist(), strict=True))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id and spans: array of (kind, start, end, base), by kind, then start."""
    own = id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    cell = "array<struct<kind:int,start:long,end:long,base:boolean,pattern:long>>"

    def find(batch: pa.RecordBatch) -> dict:
        out = []
        for t in strings_of(batch, "text"):
            out.append([{"kind": k, "start": a, "end": b, "base": base, "pattern": pattern(t, k, a, b, base)} for k, a, b, base in candidates(t)])
        return {"doc_id": batch.column("doc_id"), "found": out}

    held = write_table(map_batches(own, find, f"doc_id long, found {cell}"), "pii").df
    rows = held.select(F.explode("found.pattern").alias("pattern")).groupBy("pattern").count().collect()  # one row for each pattern, a bounded set
    odds = train({r["pattern"]: r["count"] for r in rows})

    def decide(batch: pa.RecordBatch) -> dict:
        out = []
        for found in batch.column("found").to_pylist():
            kept = [(c["kind"], c["start"], c["end"], True) for c in found if c["base"]]
            taken = Taken()
            added = sorted((-odds[c["pattern"]], c["kind"], c["start"], c["end"]) for c in found if not c["base"] and odds[c["pattern"]] >= threshold)
            for _, kind, a, b in added:
                if taken.free(a, b):
                    taken.add(a, b)
                    kept.append((kind, a, b, False))
            out.append([{"kind": KINDS[k], "start": a, "end": b, "base": base} for k, a, b, base in sorted(kept)])
        return {"doc_id": batch.column("doc_id"), "spans": out}

    return map_batches(held, decide, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, done = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def joined(found: Iterable[dict]) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in found)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans, and their number with that of the added ones."""

    def fn(batch: pa.RecordBatch) -> dict:
        every = batch.column("spans").to_pylist()
        base = [[s for s in x if s["base"]] for x in every]
        out = {f"n_{k}": [sum(s["kind"] == k for s in x) for x in base] for k in BASE_KINDS}
        return out | {"doc_id": batch.column("doc_id"), "base_sha256": [hashlib.sha256(joined(x).encode()).hexdigest() for x in base], "spans": [joined(x) for x in every], "n_spans": [len(x) for x in every], "n_added": [len(x) - len(y) for x, y in zip(every, base, strict=True)]}

    return map_batches(spans(docs), fn, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_added long")
