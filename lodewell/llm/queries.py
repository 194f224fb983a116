"""The thin queries opN_<name> and their SQL; each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, licenses, linededup, lm, packing, pii, quality, rules, simhash, tokencount
from .common import read


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(read(spark, sf_dir, "documents"))


def op2_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.digest(read(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op5_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(read(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.digest(read(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(read(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(read(spark, sf_dir, "documents"))


def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash, op2_brown, op3_quality, op4_packing, op5_tokencount, op6_decontaminate, op7_rules, op8_pii, op9_licenses, op10_linededup)
}

ORACLE: dict[str, str] = {
    "op6_decontaminate": decontaminate.ORACLE_SQL,
    "op7_rules": rules.ORACLE_SQL,
    "op10_linededup": linededup.ORACLE_SQL,
}
