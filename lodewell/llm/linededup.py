"""Cross-site line dedup with HyperLogLog spread, in DataFrame functions only.

A line is normalised (trimmed, lower-cased) and hashed. Lines with any
character left that stand on ``sites`` or more distinct sites are boilerplate,
however short they are and whatever their script. Lines whose least and greatest site hash are equal have one
site and are out at once, which is exact and spares a sketch for nearly every
line of a corpus. For the others a HyperLogLog sketch of the sites is built
before the shuffle, one for each line hash and task, and merged after it. An
estimate far from the limit decides by itself; within ``margin`` of it the
line's sites are counted exactly, so the outcome equals exact counting.

What a text loses is listed by its id and a hash of it, so a list never is
longer than one text has lines, however many rows share an id or have none.

A boilerplate line is removed from every document but the first that has it
(the smallest id), which keeps one instance of what is lost elsewhere; with
``keep_first=False`` it goes everywhere. The other lines stay, in order.

Defined results: null texts stay null and blank lines stay; a null site counts
as one site (the empty name); a null doc_id is never the first; rows with
equal ids are one document, each with its own text; an empty table gives an empty result; further columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import Table, write_table

SITES = 10
#: log2 of a sketch's buckets, and the relative band about the limit that is counted exactly: over four standard errors.
LG_K = 10
MARGIN = 0.15


def normal_line(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(" \t\r\x0b\x0c")))


def _key(doc: Column) -> Column:
    """A document's id as a join key that null ids share."""
    return F.coalesce(doc.cast("string"), F.lit("\x00"))


def _text_key(text: Column) -> Column:
    return F.xxhash64(text)


def lines_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> Table:
    """Written rows (doc, text_key, site, key): one for each non-blank line, hashed."""
    own = docs.select(F.col(id_col).alias("doc"), _text_key(F.col(text_col)).alias("text_key"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.explode(F.split(F.col(text_col), "\n", -1)).alias("line"))
    normal = own.select("doc", "text_key", "site", normal_line(F.col("line")).alias("line"))
    return write_table(normal.filter("line != ''").select("doc", "text_key", "site", F.xxhash64("line").alias("key")), "lines")


def boilerplate(lines: Table, sites: int = SITES, margin: float = MARGIN) -> Table:
    """Written rows (key, first): hashes of lines on ``sites`` or more sites, and the first document of each."""
    ends = lines.df.withColumn("h", F.xxhash64("site")).groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.min("doc").alias("first"))
    several = write_table(ends.filter("a != b" if sites > 1 else "true").select("key", "first"), "line-several")
    held = lines.df.join(several.joinable(), "key")
    sketched = held.groupBy("key").agg(F.min("first").alias("first"), F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    spread = write_table(sketched.select("key", "first", F.hll_sketch_estimate("sketch").alias("n")), "line-spread")
    sure = spread.df.filter(F.col("n") > sites * (1 + margin)).select("key", "first")
    near = write_table(spread.df.filter(F.col("n").between(sites * (1 - margin), sites * (1 + margin))).select("key", "first"), "line-near")
    exact = lines.df.join(near.joinable(), "key").groupBy("key", "site").agg(F.min("first").alias("first")).groupBy("key").agg(F.min("first").alias("first"), F.count("*").alias("n"))
    return write_table(sure.unionByName(exact.filter(F.col("n") >= sites).select("key", "first")), "line-boilerplate")


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES, keep_first: bool = True, drop_emptied: bool = False) -> tuple[DataFrame, Table]:
    """(``docs`` with cleaned texts, the removal list (doc_key, text_key, keys) of each text that lost lines).

    With ``drop_emptied`` a document that had words and keeps none goes; one
    that was blank before stays.
    """
    lines = lines_table(docs, id_col, text_col, site_col)
    known = boilerplate(lines, sites)
    found = lines.df.join(known.joinable(), "key")
    if keep_first:
        found = found.filter(F.col("first").isNull() | F.col("doc").isNull() | (F.col("doc") != F.col("first")))
    lost = write_table(found.groupBy(_key(F.col("doc")).alias("doc_key"), "text_key").agg(F.collect_set("key").alias("keys")), "line-lost")
    side = lost.joinable()
    joined = docs.join(side, (_key(docs[id_col]) == side["doc_key"]) & (_text_key(docs[text_col]) == side["text_key"]), "left")
    kept = F.filter(F.split(docs[text_col], "\n", -1), lambda line: ~F.array_contains(side["keys"], F.xxhash64(normal_line(line))))
    text = F.when(side["keys"].isNull(), docs[text_col]).otherwise(F.array_join(kept, "\n"))
    if drop_emptied:
        joined = joined.filter(side["keys"].isNull() | has_words(text) | ~has_words(docs[text_col]))
    return joined.select(*(text.alias(c) if c == text_col else docs[c] for c in docs.columns)), lost


def has_words(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\r\n\x0b\x0c")) != ""


def dedup_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents with boilerplate removed, columns unchanged; an emptied one goes, as each of its lines stands in an earlier one."""
    return remove_boilerplate(docs, drop_emptied=True, **options)[0]


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_kept and the MD5 of the cleaned text, for every document."""
    both = docs.select("doc_id", "source", "text", F.size(F.split("text", "\n", -1)).alias("n_lines"))
    cleaned, _ = remove_boilerplate(both)
    n_lines = F.when(F.col("n_lines") > 0, F.col("n_lines")).otherwise(F.lit(0)).cast("long")
    n_kept = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    return cleaned.select("doc_id", n_lines.alias("n_lines"), n_kept.alias("n_kept"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


ORACLE_SQL = f"""
with lines as (
  select doc_id, coalesce(source, '') as site, u.pos as pos, u.line as line,
         lower(trim(u.line, ' ' || chr(9) || chr(13) || chr(11) || chr(12))) as normal
  from documents, lateral (select unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos) u
), spread as (
  select normal, min(doc_id) as first_doc from lines
  where normal <> ''
  group by normal having count(distinct site) >= {SITES}
), marked as (
  select l.doc_id, l.pos, l.line, s.normal is not null and l.doc_id <> s.first_doc as gone
  from lines l left join spread s on l.normal = s.normal
)
select doc_id, count(*) as n_lines,
       case when count(*) filter (where not gone) = 0 then 1 else count(*) filter (where not gone) end as n_kept,
       md5(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as text_md5
from marked group by doc_id
union all
select doc_id, 0, 0, null from documents where text is null
"""
