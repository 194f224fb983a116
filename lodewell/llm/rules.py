"""Quality rules: shape of the text, and lines that too many documents of a host share.

The rules on a text alone are counted in one pass. In the same pass every
distinct line of a document is normalised (trimmed, lower-cased, inner ASCII
white space squeezed) and hashed, if it has ``MIN_WORDS`` words. A line is
boilerplate of its host if more distinct documents than the host's limit have
it: ``MIN_DOCS``, or ``SHARE`` of the host's documents if that is more. It
counts as removed from all but the first of them (the smallest id). A
document whose removed words are more than ``DEPLETED`` of all is rejected.
``verdicts`` counts all this; ``cleaned`` gives the kept documents without
their removed lines.

The number of rows with a line bounds its number of documents from above, so
only lines over the least limit are counted exactly.

Defined results: null and blank texts have no words and fail the base rules; a
null host is one host (the empty name); rows with equal ids are one document
in the counts and get a verdict each; a null doc_id is no document for the
counts and is never the first; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import write_table
from .common import ASCII_SPACE, map_batches, strings_of

MIN_WORDS = 3
MIN_DOCS = 20
SHARE = 0.001
DEPLETED = 0.8
WINDOW = 8
LEAST_WORDS = 20
REPEATED_PERCENT = 30

_SYMBOLS = re.compile(r"[#*$%&|<>]")


def repeated_words(w: list, size: int = WINDOW) -> int:
    """Words inside any window of ``size`` words that occurs twice or more, first occurrences included."""
    n = len(w) - size + 1
    if n < 2:
        return 0
    ids: dict = {}
    code = np.fromiter((ids.setdefault(x, len(ids)) for x in w), np.int64, len(w))
    if len(ids) > len(w) - size:  # as many repeats as a repeated window needs there are not
        return 0
    span = 1
    while span < size:  # numbers of doubled windows: exact, no hash
        step = min(span, size - span)
        pair = code[:-step] * (int(code.max()) + 1) + code[step:]
        code = np.unique(pair, return_inverse=True)[1]
        span += step
    twice = np.bincount(code)[code] > 1
    edge = np.zeros(len(w) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def shape(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = text.encode().split()
    word_chars = len(text) - sum(text.count(c) for c in ASCII_SPACE)
    n_symbols = len(_SYMBOLS.findall(text))
    lines = Counter(text.split("\n"))
    n_dup = sum(n - 1 for line, n in lines.items() if n > 1 and line.strip(ASCII_SPACE))
    return len(w), word_chars, n_symbols, n_dup, repeated_words(w)


def line_key(line: str) -> tuple[int, int]:
    """(key, words) of a lower-cased line."""
    w = line.encode().split()
    return xxhash.xxh64_intdigest(b" ".join(w)) - (1 << 63), len(w)


def line_counts(text: str, min_words: int = MIN_WORDS) -> list[dict]:
    """(key, words) of each distinct eligible line; words counts all its instances."""
    out: dict[int, int] = {}
    for key, n in map(line_key, text.lower().split("\n")):
        if n >= min_words:
            out[key] = out.get(key, 0) + n
    return [{"key": k, "words": n} for k, n in out.items()]


def _without(text: str, keys: set[int], min_words: int = MIN_WORDS) -> str:
    """The text without its eligible lines of these keys."""
    pairs = zip(text.split("\n"), map(line_key, text.lower().split("\n")), strict=True)
    return "\n".join(line for line, (key, n) in pairs if n < min_words or key not in keys)


_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _rated(numbered: DataFrame, min_docs: int, share: float, depleted: float) -> tuple[DataFrame, DataFrame]:
    """For (rid, doc_id, host, text): each row's verdict with its rid, and (rid, key, words) of the lines that it loses."""

    def fn(batch: pa.RecordBatch) -> dict:
        texts = strings_of(batch, "text")
        found = [shape(t) for t in texts]
        return {k: batch.column(k) for k in ("rid", "doc_id", "host")} | {"lines": [line_counts(t) for t in texts]} | {name: [x[k] for x in found] for k, name in enumerate(_NAMES)}

    schema = "rid long, doc_id long, host string, lines array<struct<key:long,words:long>>, " + ", ".join(f"{n} long" for n in _NAMES)
    base = write_table(map_batches(numbered, fn, schema), "rules-base")

    lines = base.df.select("rid", "doc_id", "host", F.explode("lines").alias("line")).select("rid", "doc_id", "host", "line.key", "line.words")
    hosts = base.df.groupBy("host").agg(F.count_distinct("doc_id").alias("docs"))
    limit = F.greatest(F.lit(float(min_docs)), F.lit(share) * F.col("docs"))
    often = lines.groupBy("host", "key").agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("first")).filter(F.col("n") > min_docs)
    maybe = write_table(often.join(hosts, "host").filter(F.col("n") > limit).select("host", "key", "first", limit.alias("most")), "rules-often")
    exact = lines.join(maybe.joinable(), ["host", "key"]).groupBy("host", "key").agg(F.min("first").alias("first"), F.min("most").alias("most"), F.count_distinct("doc_id").alias("n"))
    over = write_table(exact.filter(F.col("n") > F.col("most")).select("host", "key", "first"), "rules-over")
    lost = lines.join(over.joinable(), ["host", "key"]).filter(F.col("doc_id").isNull() | (F.col("doc_id") != F.col("first"))).select("rid", "key", "words")
    gone = F.coalesce("removed", F.lit(0).cast("long"))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEATED_PERCENT)
    joined = base.df.drop("lines").join(lost.groupBy("rid").agg(F.sum("words").alias("removed")), "rid", "left")
    return joined.select("rid", "doc_id", *_NAMES, gone.alias("removed_words"), failed.alias("base_failed"), (~failed & (gone <= F.lit(depleted) * F.col("n_words"))).alias("kept")), lost


def _numbered(docs: DataFrame, rid: Column, id_col: str, text_col: str, host_col: str) -> DataFrame:
    return docs.select(rid.alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(text_col).cast("string").alias("text"))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE, depleted: float = DEPLETED) -> DataFrame:
    """doc_id, the shape counts, removed_words, base_failed and kept for every row."""
    return _rated(_numbered(docs, F.monotonically_increasing_id(), id_col, text_col, host_col), min_docs, share, depleted)[0].drop("rid")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE, depleted: float = DEPLETED) -> DataFrame:
    """The documents that ``verdicts`` keeps, without the lines it counts as removed; columns unchanged."""
    rid, keys = "_rules_row", "_rules_keys"
    while {rid, keys} & set(docs.columns):
        rid, keys = rid + "_", keys + "_"
    rows = write_table(docs.withColumn(rid, F.monotonically_increasing_id()), "rules-docs").df
    rated, lost = _rated(_numbered(rows, F.col(rid), id_col, text_col, host_col), min_docs, share, depleted)
    lists = lost.groupBy(F.col("rid").alias(rid)).agg(F.collect_list("key").alias(keys))
    kept = rows.join(rated.filter("kept").select(F.col("rid").alias(rid)), rid, "left_semi").join(lists, rid, "left")

    def fn(batch: pa.RecordBatch) -> dict:
        texts = [t if k is None else _without(t, set(k)) for t, k in zip(batch.column(text_col).to_pylist(), batch.column(keys).to_pylist(), strict=True)]
        return {f: batch.column(f) for f in batch.schema.names} | {text_col: texts}

    return map_batches(kept.select(*docs.columns, keys), fn, docs.schema)


def digest(docs: DataFrame) -> DataFrame:
    return verdicts(docs)


ORACLE_SQL = rf"""
with docs as (
  select doc_id, coalesce(source, '') as host, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents
), lines as (
  select doc_id, host, unnest(string_split(text, chr(10))) as line from docs
), dup as (
  select doc_id, sum(n - 1)::bigint as n_dup_lines
  from (select doc_id, line, count(*) as n from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by all)
  group by doc_id
), windows as (
  select doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') as gram
  from docs, lateral (select unnest(range(1, len(w) - {WINDOW - 2})) as i)
), twice as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, gram) as n from windows) where n > 1
), repeats as (
  select doc_id, count(distinct p) as n_repeat_words
  from (select doc_id, unnest(range(i, i + {WINDOW})) as p from twice) group by doc_id
), normal as (
  select doc_id, host, array_to_string(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+'), ' ') as norm,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as words
  from lines
), eligible as (select * from normal where words >= {MIN_WORDS}),
hosts as (select host, count(distinct doc_id) as docs from docs group by host),
over_limit as (
  select e.host, e.norm, min(e.doc_id) as first_doc
  from eligible e join hosts h on e.host = h.host
  group by e.host, e.norm, h.docs having count(distinct e.doc_id) > greatest({MIN_DOCS}, {SHARE} * h.docs)
), removed as (
  select e.doc_id, sum(e.words)::bigint as removed_words
  from eligible e join over_limit o on e.host = o.host and e.norm = o.norm
  where e.doc_id <> o.first_doc group by e.doc_id
)
select d.doc_id, len(w) as n_words,
       length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
       length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
       coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
       coalesce(removed_words, 0) as removed_words,
       len(w) < {LEAST_WORDS} or coalesce(n_repeat_words, 0) * 100 > len(w) * {REPEATED_PERCENT} as base_failed,
       not (len(w) < {LEAST_WORDS} or coalesce(n_repeat_words, 0) * 100 > len(w) * {REPEATED_PERCENT})
         and coalesce(removed_words, 0) <= {DEPLETED} * len(w) as kept
from docs d left join dup using (doc_id) left join repeats using (doc_id) left join removed using (doc_id)
"""
