"""Bit fields, unsigned order and integer arithmetic on 64-bit words held as BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bits(word: Column, at: int, n: int) -> Column:
    """``n`` bits of a word from bit ``at`` up."""
    return F.shiftrightunsigned(word, at).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def pack(*fields: tuple[Column, int]) -> Column:
    """Fields shifted to their bit positions and or-ed together."""
    out = F.lit(0).cast("long")
    for value, at in fields:
        out = out.bitwiseOR(F.shiftleft(value.cast("long"), at))
    return out


def unsigned(word: Column) -> Column:
    """A BIGINT's 64 bits as an unsigned DECIMAL(20,0): for order and print."""
    wide = word.cast("decimal(20,0)")
    return F.when(word < 0, (wide + F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(wide)


def power_of_two(x: Column) -> Column:
    return F.bit_count(x) == 1


def div_ceil(a: Column, b: int) -> Column:
    return F.floor((a + F.lit(b - 1)) / F.lit(b)).cast("long")


def saturating_multiply(a: Column, b: Column) -> Column:
    """a * b, or the greatest BIGINT where that overflows (ANSI mode would raise)."""
    return F.coalesce(F.try_multiply(a, b), F.lit((1 << 63) - 1))


def dirent_object(value: Column) -> Column:
    """Object number of a directory entry: the low 48 bits."""
    return bits(value, 0, 48)


def dirent_type(value: Column) -> Column:
    """File type of a directory entry: the top 4 bits."""
    return bits(value, 60, 4)
