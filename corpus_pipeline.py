"""The corpus pipeline: quality, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; every stage but the last returns the columns of ``documents``.

Defined results, for every stage: an empty table gives an empty result; further
columns, whatever their names, are kept as they are (the last stage drops
them); rows that repeat an id are scored, cut and packed one by one. What a
stage does with nulls, blank texts and ties, its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodewell.llm import decontaminate, linededup, packing, quality, simhash
from lodewell.llm.common import read
from lodewell.runtime import write_table

def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not reject.

    Null and blank texts have the score of a zero difference; null ids are
    scored, but never training rows; without labels of both kinds all stay. A
    score of exactly 0.5 stays.
    """
    return quality.keep_good(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without cross-site boilerplate lines.

    Null and blank texts stay as they are; a text that loses all its words
    goes; of several documents with a line the one with the least id keeps it,
    and a null id never is the least; a null source is a site of its own.
    """
    return linededup.dedup_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group connected by pairs whose five-word shingles are 0.8 alike or more.

    The one with the least id stays, of rows that repeat it one; null and
    blank texts are one group; rows without an id all stay.
    """
    return simhash.near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark.

    Null and wordless texts hit nothing and stay; items without an id or with
    equal ids hit like any other.
    """
    return decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' token pieces, packed into sequences.

    A null or empty text is its end token alone; a null id stays null; pieces
    of equal length take any order among their places.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontamination),
    ("packing", pack),
]

#: A compression classifier and tokenisation are not SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each hands on is written to the shared folder until the next has written its own."""
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        table = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            last.drop()
        docs, last = table.df, table
    return STAGES[-1][1](spark, docs, sf_dir)
