"""Brown class-based bigram model: exchange clustering, smoothed scores and perplexity.

P(w | v) = P(class(w) | class(v)) * P(w | class(w)).

Two passes read the texts: one counts all words (a written table, as large as
the vocabulary), one writes each text as word numbers, beside the words that
have none. Every word that the training texts have twice or more gets a class
by exchange, that is, by the gain in class-bigram likelihood:

1. the ``CORE`` most frequent words by sweeps over their bigram counts, each
   moved in turn;
2. the other numbered words in ``STEPS`` steps: their class contexts are
   counted over all training texts and each moves to its best class, all of a
   step at once, on the executors;
3. the words without a number likewise, in one step, by their contexts among
   the numbered ones.

Then class bigrams are counted over the finished classes of all words. Words
met once share the rare class, whose other half is for unknown words: as much
weight as all words met once have, shared by as many unseen words as the
counts of words met once and twice let expect (Chao's estimate). So the
emissions of a class sum to one over its known and expected unseen words.

Bounds: the driver and the tasks hold ``HEAD`` words of up to ``WORD_BYTES``
bytes with their classes and the core's matrix, none of which grows with the
corpus. The other words are not dropped: they travel as rows, are placed by a
shuffle and meet their texts in a join.

Defined results: null and blank texts are the end alone; a null doc_id counts
as the empty text for the split and is a training row; repeated rows train
and score one by one; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..runtime import Table, write_table
from .common import hash_bucket, id_text, lower_words, short_batches, texts_of

HEAD = 1 << 18
CORE = 1 << 10
CLASSES = 64
SWEEPS, STEPS = 4, 2
WORD_BYTES = 64
#: Words that a counting task holds before it passes them on.
HELD_WORDS = 300_000
#: Tokens that a task gathers before it counts pairs.
FOLD = 1 << 21
PRIOR = 8.0
FOLDS, HELD = 7, 2
#: Word numbers and classes 0 and 1 are the end and the rare words; the end's word is empty, which no word is.
END, RARE, FIRST = 0, 1, 2

_lookups: dict[str, dict[bytes, int]] = {}


@dataclass
class Head:
    """The frequent words in order of falling count; numbers start at FIRST."""

    words: list[bytes]
    counts: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def lookup(self) -> dict[bytes, int]:
        if self.name not in _lookups:
            _lookups.clear()
            _lookups[self.name] = {w: i for i, w in enumerate(self.words, FIRST)}
        return _lookups[self.name]


@dataclass
class Model:
    head: Head
    classes: np.ndarray  # of each word number
    transition: np.ndarray  # log10 P(class | class)
    in_class: np.ndarray  # tokens of each class; the rare one has its unknown half too
    ends: int
    n: int
    v: int
    unknown: float  # log10 P(an unknown word | rare class)

    def emission(self, count: np.ndarray, of: np.ndarray) -> np.ndarray:
        """log10 P(word | its class) of words with these training counts and classes."""
        return np.where(count > 0, np.log10(np.maximum(count, 1) / np.maximum(self.in_class[of], 1)), self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        """log10 of the add-one unigram."""
        return np.log10((count + 1) / (self.n + self.v + 1))

    def numbered(self) -> tuple[np.ndarray, np.ndarray]:
        """(emission, base) of each word number; RARE's are not used."""
        own = np.concatenate([[self.ends, 0], self.head.counts])
        return self.emission(own, self.classes), self.base(own)


def _arrow(schema: str) -> tuple[StructType, pa.Schema]:
    target = _parse_datatype_string(schema)
    return target, to_arrow_schema(target)


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Short stretches of the batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield batch.slice(at, 256)


def vocabulary(train: DataFrame) -> Table:
    """Written rows (word, c) over all training texts; the empty word stands for the ends."""
    target, arrow = _arrow("word string, c long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array(list(held), pa.binary()).cast(pa.string())
            counts = pa.array(list(held.values()), pa.int64())
            held.clear()
            return pa.RecordBatch.from_arrays([words, counts], schema=arrow)

        for batch in _slices(batches):
            for text in texts_of(batch, "text"):
                held.update(lower_words(text))
                if len(held) > HELD_WORDS:
                    yield out()
            held[b""] += batch.num_rows
        if held:
            yield out()

    return write_table(train.select("text").mapInArrow(run, target).groupBy("word").agg(F.sum("c").alias("c")), "lm-words")


def _head(words: Table, size: int) -> Head:
    """The most frequent words met at least twice; ``size`` short rows reach the driver."""
    rows = words.df.filter((F.col("word") != "") & (F.col("c") > 1) & (F.octet_length("word") <= WORD_BYTES)).orderBy(F.desc("c"), "word").limit(size).toArrow()
    return Head([w.encode() for w in rows["word"].to_pylist()], np.array(rows["c"].to_pylist(), np.int64))


def encode(docs: DataFrame, head: Head) -> Table:
    """Written rows (rid, doc_id, train, numbers, tail) of (doc_id, train, text).

    ``numbers`` holds the word numbers and the end as little-endian 32-bit
    integers, ``tail`` the words without a number of their own, in the order
    of the places that hold RARE. The row id is fixed once the table is written.
    """
    shared = docs.sparkSession.sparkContext.broadcast(head)
    target, arrow = _arrow("rid long, doc_id long, train boolean, numbers binary, tail array<string>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.lookup().get
        rid = TaskContext.get().partitionId() << 36
        for batch in _slices(batches):
            numbers, tails = [], []
            for text in texts_of(batch, "text"):
                w = lower_words(text)
                own = [get(x, RARE) for x in w]
                tails.append([x.decode() for x, k in zip(w, own, strict=True) if k == RARE])
                own.append(END)
                numbers.append(np.array(own, "<i4").tobytes())
            ids = pa.array(range(rid, rid + batch.num_rows), pa.int64())
            rid += batch.num_rows
            yield pa.RecordBatch.from_arrays([ids, batch.column("doc_id"), batch.column("train"), pa.array(numbers, pa.binary()), pa.array(tails, arrow.field("tail").type)], schema=arrow)

    return write_table(docs.select("doc_id", "train", "text").mapInArrow(run, target), "lm-numbers")


def _pair_counts(encoded: Table, codes: Callable[[np.ndarray], np.ndarray], size: int | None = None) -> DataFrame:
    """Rows (code, n) over the training texts, counted in the tasks but not summed over them.

    ``codes`` maps a stream of word numbers that starts with an end to long
    codes, below ``size`` if that is given (and then counted densely).
    """
    target, arrow = _arrow("code long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size or 0, np.int64)
        parts: list[np.ndarray] = []
        held = 0

        def rows(found: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(found), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(found[at : at + (1 << 17)], pa.int64()), pa.array(n[at : at + (1 << 17)], pa.int64())], schema=arrow)

        def flush() -> Iterator[pa.RecordBatch]:
            own = codes(np.concatenate([np.array([END], np.int32), *parts]))
            parts.clear()
            if size is None:
                yield from rows(*np.unique(own, return_counts=True))
            else:
                total.__iadd__(np.bincount(own, minlength=size))

        for batch in _slices(batches):
            parts.append(np.frombuffer(b"".join(batch.column("numbers").to_pylist()), "<i4"))
            held += len(parts[-1])
            if held > FOLD:
                yield from flush()
                held = 0
        if parts:
            yield from flush()
        if size is not None:
            yield from rows(found := np.flatnonzero(total), total[found])

    return encoded.df.filter("train").select("numbers").mapInArrow(run, target)


def _dense(counts: DataFrame, size: int) -> np.ndarray:
    """Counts of a bounded code space as an array on the driver."""
    rows = counts.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[rows["code"].to_numpy()] = rows["n"].to_numpy()
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def gains(table: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Rise of the class-bigram log likelihood if a word with these context counts joins each class.

    ``before[c]`` counts the word after class c, ``after[c]`` before class c.
    """
    n, m = before.sum(), after.sum()
    left, right = table.sum(1), table.sum(0)
    pairs = (_xlogx(table + after) - _xlogx(table)).sum(1) + (_xlogx(table.T + before) - _xlogx(table.T)).sum(1)
    return pairs - (_xlogx(left + m) - _xlogx(left)) - (_xlogx(right + n) - _xlogx(right))


def exchange(pairs: np.ndarray, fixed: int, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of the symbols of a bigram matrix: the first ``fixed`` keep their own, the rest move between the others."""
    size = len(pairs)
    of = np.array([s if s < fixed else fixed + (s - fixed) % max(1, classes - fixed) for s in range(size)])
    table = np.zeros((classes, classes), np.int64)
    np.add.at(table, (of[:, None], of[None, :]), pairs)
    for _ in range(sweeps):
        moved = 0
        for s in range(fixed, size):
            after = np.bincount(of, pairs[s], classes).astype(np.int64)
            before = np.bincount(of, pairs[:, s], classes).astype(np.int64)
            old, own = of[s], pairs[s, s]
            # Out of its class: its rows and columns go, a pair with itself was counted in both.
            table[old] -= after
            table[:, old] -= before
            table[old, old] += own
            after[old] -= own
            before[old] -= own
            gain = gains(table, before, after)
            gain[:fixed] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = int(old)
            moved += new != old
            of[s] = new
            after[new] += own
            before[new] += own
            table[new] += after
            table[:, new] += before
            table[new, new] -= own
        if not moved:
            break
    return of


def best_classes(table: np.ndarray, fixed: int, starts: np.ndarray, cell: np.ndarray, n: np.ndarray, old: np.ndarray | None = None) -> np.ndarray:
    """The class, not below ``fixed``, that each word gains most in; the table is held.

    A word's cells begin at its start: ``cell`` g counts the word after class g,
    ``cell`` len(table) + g before it. A word in class ``old`` is in the table
    already, and its gain there is what it would lose by leaving.
    """
    groups = len(table)
    after, g = cell >= groups, cell % groups
    word = np.repeat(np.arange(len(starts)), np.diff([*starts, len(cell)]))
    here = np.where(after[:, None], table.T[g], table[g])
    rise = _xlogx(here + n[:, None]) - _xlogx(here)
    if old is not None:
        own = here[np.arange(len(cell)), old[word]]
        rise[np.arange(len(cell)), old[word]] = _xlogx(own) - _xlogx(np.maximum(own - n, 0))
    gain = np.add.reduceat(rise, starts)
    for total, m in ((table.sum(1), n * after), (table.sum(0), n * ~after)):
        m = np.add.reduceat(m, starts)
        fall = _xlogx(total + m[:, None]) - _xlogx(total)
        if old is not None:
            every = np.arange(len(starts))
            fall[every, old] = _xlogx(total[old]) - _xlogx(np.maximum(total[old] - m, 0))
        gain -= fall
    gain[:, :fixed] = -np.inf
    return np.argmax(gain, axis=1)


def _best_of(batches: Iterable[pa.RecordBatch], table: np.ndarray, fixed: int, of: np.ndarray | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, classes, contexts after a class) of stretches of rows (w, cells), with ``of`` from w to its class now."""
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            lists = part.column("cells")
            flat = lists.flatten()
            starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
            cell, n = flat.field("cell").to_numpy(), flat.field("n").to_numpy()
            old = None if of is None else of[part.column("w").to_numpy()]
            yield part, best_classes(table, fixed, starts, cell, n, old), np.add.reduceat(n * (cell < len(table)), starts)


def _by_word(contexts: DataFrame) -> DataFrame:
    """Rows (w, cells) of partial counts (w, cell, n): a word has two cells for each class at most."""
    return contexts.repartition("w").groupBy("w", "cell").agg(F.sum("n").alias("n")).groupBy("w").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))


def _step(encoded: Table, first: int, of: np.ndarray, table: np.ndarray, placed: bool) -> np.ndarray:
    """One exchange step of the word numbers from ``first`` on: their classes by their contexts under ``of``, the table held."""
    groups = len(table)
    spark = encoded.spark
    shared = spark.sparkContext.broadcast((of, table))

    def codes(stream: np.ndarray) -> np.ndarray:
        of = shared.value[0]
        inner = stream >= first
        here, then = np.flatnonzero(inner[1:]) + 1, np.flatnonzero(inner[:-1])
        before = stream[here].astype(np.int64) * 2 * groups + of[stream[here - 1]]
        after = stream[then].astype(np.int64) * 2 * groups + groups + of[stream[then + 1]]
        return np.concatenate([before, after])

    counts = _pair_counts(encoded, codes)
    cells = _by_word(counts.select((F.col("code") / F.lit(2 * groups)).cast("long").alias("w"), (F.col("code") % F.lit(2 * groups)).alias("cell"), "n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, table = shared.value
        for part, best, _ in _best_of(batches, table, 3, of if placed else None):
            yield pa.RecordBatch.from_arrays([part.column("w"), pa.array(best, pa.int64())], names=["w", "class"])

    found = cells.mapInArrow(run, "w long, class long").toArrow()  # ``HEAD`` rows at most
    out = of.copy()
    out[found["w"].to_numpy()] = found["class"].to_numpy()
    return out


def _table(encoded: Table, of: np.ndarray, classes: int) -> np.ndarray:
    """Class-bigram counts over the word numbers' classes."""
    shared = encoded.spark.sparkContext.broadcast(of)
    return _dense(_pair_counts(encoded, lambda s: shared.value[s[:-1]] * classes + shared.value[s[1:]], classes * classes), classes * classes).reshape(classes, classes)


def _tail_words(encoded: Table, of: np.ndarray, table: np.ndarray) -> Table:
    """Written rows (word, c, class) of the training words without a number; those met once are rare."""
    groups = len(table)
    shared = encoded.spark.sparkContext.broadcast((of, table))
    target, arrow = _arrow("w string, cell long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value[0]
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(held)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array(list(held.values()), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        for batch in _slices(batches):
            for raw, tail in zip(batch.column("numbers").to_pylist(), batch.column("tail").to_pylist(), strict=True):
                if not tail:
                    continue
                own = np.frombuffer(raw, "<i4")
                c, at = of[own], np.flatnonzero(own == RARE)
                before = np.where(at > 0, c[at - 1], END)
                held.update(zip(tail, before.tolist(), strict=True))
                held.update(zip(tail, (groups + c[at + 1]).tolist(), strict=True))  # the end is always after
            if len(held) > HELD_WORDS:
                yield out()
        if held:
            yield out()

    cells = _by_word(encoded.df.filter("train").select("numbers", "tail").mapInArrow(run, target))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, best, c in _best_of(batches, shared.value[1], 3):
            yield pa.RecordBatch.from_arrays([part.column("w"), pa.array(c, pa.int64()), pa.array(np.where(c > 1, best, RARE), pa.int64())], names=["word", "c", "class"])

    return write_table(cells.mapInArrow(place, "word string, c long, class long"), "lm-tail")


def train_model(docs: DataFrame, head_words: int = HEAD, core_words: int = CORE, classes: int = CLASSES, steps: int = STEPS) -> tuple[Model, Table, Table]:
    """Fit the classes on the rows of (doc_id, train, text) with ``train``.

    Also gives the words without a number (word, c, class) and all rows in
    classes, see ``_classed``.
    """
    short_batches(docs.sparkSession)
    words = vocabulary(docs.filter("train"))
    n, v, once, twice, ends = words.df.agg(F.sum("c"), F.count("*"), F.sum((F.col("c") == 1).cast("long")), F.sum((F.col("c") == 2).cast("long")), F.max(F.when(F.col("word") == "", F.col("c")))).first()
    n, v, once, twice, ends = (x or 0 for x in (n, v, once, twice, ends))
    head = _head(words, head_words)
    encoded = encode(docs, head)
    core = min(core_words, len(head.words))
    classes = max(4, min(classes, 3 + core))

    # Symbols of the core's matrix: end, rare, the other head words, then the core.
    symbols = np.concatenate([[0, 1], np.arange(core) + 3, np.full(len(head.words) - core, 2)]).astype(np.int64)
    size = core + 3
    pairs = _dense(_pair_counts(encoded, lambda s: symbols[s[:-1]] * size + symbols[s[1:]], size * size), size * size).reshape(size, size)
    of_core = exchange(pairs, 3, classes)
    of = np.full(FIRST + len(head.words), 2, np.int64)  # class 2 stands for the words that are not placed yet
    of[[END, RARE]] = END, RARE
    of[FIRST : FIRST + core] = of_core[3:]
    table = np.zeros((classes, classes), np.int64)
    np.add.at(table, (of_core[:, None], of_core[None, :]), pairs)
    if len(head.words) > core:
        for step in range(steps):
            of = _step(encoded, FIRST + core, of, table, placed=step > 0)
            table = _table(encoded, of, classes)
    tail = _tail_words(encoded, of, table)

    in_class = np.bincount(of, np.concatenate([[ends, 0], head.counts]), classes)
    for r in tail.df.groupBy("class").agg(F.sum("c").alias("c")).collect():  # one row for each class
        in_class[r["class"]] += r["c"]
    weight = max(1, once)
    in_class[RARE] += weight
    unseen = max(1.0, weight * weight / (2 * max(1, twice)))
    model = Model(head, of, np.zeros((classes, classes)), in_class, ends, n, v, float(np.log10(weight / in_class[RARE] / unseen)))
    rows = _classed(encoded, model, tail)
    encoded.drop()
    model.transition = _transition(rows, classes)
    return model, tail, rows


def _classed(encoded: Table, model: Model, tail: Table) -> Table:
    """Written rows (doc_id, train, n_tokens, n_known, base, emission, classes) of all texts, classes as bytes."""
    spot = encoded.df.select("rid", F.posexplode("tail").alias("k", "word"))
    met = spot.join(tail.df, "word", "left").select("rid", F.struct("k", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("class", F.lit(RARE)).cast("int").alias("class")).alias("t"))
    lists = met.groupBy("rid").agg(F.collect_list("t").alias("found"))  # as long as the text's own tail
    joined = encoded.df.drop("tail").join(lists, "rid", "left")
    shared = encoded.spark.sparkContext.broadcast((model, *model.numbered()))
    target, arrow = _arrow("doc_id long, train boolean, n_tokens long, n_known long, base double, emission double, classes binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, emission, base = shared.value
        for batch in _slices(batches):
            out: dict = {f.name: [] for f in list(arrow)[2:]}
            lists = batch.column("found")
            flat = lists.flatten()
            rank, counts, kinds = (flat.field(i).to_numpy() for i in range(3))
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for i, raw in enumerate(batch.column("numbers").to_pylist()):
                own = np.frombuffer(raw, "<i4")
                order = np.argsort(rank[at[i] : at[i + 1]])
                c, kind = counts[at[i] : at[i + 1]][order], kinds[at[i] : at[i + 1]][order]
                of = model.classes[own]
                known = own != RARE
                of[~known] = kind
                out["n_tokens"].append(len(own))
                # The end is a known token wherever there was a training text.
                out["n_known"].append(int(known.sum()) - (not model.n) + int((c > 0).sum()))
                out["base"].append(float(base[own[known]].sum() + model.base(c).sum()))
                out["emission"].append(float(emission[own[known]].sum() + model.emission(c, kind).sum()))
                out["classes"].append(of.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("train"), *(pa.array(out[f.name], f.type) for f in list(arrow)[2:])], schema=arrow)

    return write_table(joined.select("doc_id", "train", "numbers", "found").mapInArrow(run, target), "lm-classed")


def _transition(rows: Table, classes: int) -> np.ndarray:
    """Smoothed log10 P(class | class) from the training rows."""
    target, arrow = _arrow("code long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        for batch in batches:
            stream = np.frombuffer(bytes([END]) + b"".join(batch.column("classes").to_pylist()), np.uint8).astype(np.int64)
            total += np.bincount(stream[:-1] * classes + stream[1:], minlength=classes * classes)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], schema=arrow)

    counts = _dense(rows.df.filter("train").select("classes").mapInArrow(run, target), classes * classes).reshape(classes, classes)
    unigram = (counts.sum(0) + 1) / (counts.sum() + classes)
    return np.log10((counts + PRIOR * unigram) / (counts.sum(1, keepdims=True) + PRIOR))


def score(rows: Table, model: Model) -> DataFrame:
    """Rows in classes -> doc_id, train, n_tokens, n_known, base_score, score, perplexity."""
    shared = rows.spark.sparkContext.broadcast(model.transition)
    target, arrow = _arrow("doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double, perplexity double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transition = shared.value
        for batch in _slices(batches):
            total = []
            for raw, emission in zip(batch.column("classes").to_pylist(), batch.column("emission").to_pylist(), strict=True):
                c = np.frombuffer(raw, np.uint8)
                total.append(float(transition[np.concatenate([[END], c[:-1]]), c].sum()) + emission)
            n = batch.column("n_tokens").to_numpy()
            with np.errstate(over="ignore"):
                perplexity = 10.0 ** (-np.array(total) / n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("train"), batch.column("n_tokens"), batch.column("n_known"), batch.column("base"), pa.array(total, pa.float64()), pa.array(perplexity, pa.float64())], schema=arrow)

    return rows.df.mapInArrow(run, target)


def digest(docs: DataFrame, **sizes: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    own = id_text(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    split = own.withColumn("train", hash_bucket(F.col("doc_id"), FOLDS) != HELD)
    model, _, rows = train_model(split, **sizes)
    found = score(rows, model)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
