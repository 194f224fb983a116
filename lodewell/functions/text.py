"""Names, times, sizes and identifiers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso8601(seconds: Column) -> Column:
    """UTC time of Unix seconds, whatever the session's zone, before 1970 too."""
    day = F.floor(seconds / 86400).cast("int")
    rest = F.pmod(seconds, F.lit(86400))
    date = F.date_add(F.lit("1970-01-01").cast("date"), day)
    return F.concat(F.date_format(date, "yyyy-MM-dd"), F.format_string("T%02d:%02d:%02dZ", F.floor(rest / 3600), F.floor(rest % 3600 / 60), (rest % 60).cast("long")))


def parse_time(text: Column) -> Column:
    """Unix seconds from digits or an RFC 3339 time with an offset; null if it is neither or no real date."""
    shape = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
    return F.when(text.rlike(r"^\d+$"), text.try_cast("long")).when(text.rlike(shape), F.unix_seconds(F.try_to_timestamp(F.upper(text).try_cast("string"))))


def hex_id(word: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(word), 16, "0")))


def split_head(name: Column, at: str = "@") -> Column:
    return F.split_part(name, F.lit(at), F.lit(1))


def describe(*parts: Column) -> Column:
    """The known parts, separated by spaces."""
    return F.concat_ws(" ", *parts)


def human_size(n: Column, units: str = "KMGT") -> Column:
    """Bytes as B or one of ``units`` with one decimal below ten units; what is beyond the last unit stays in it."""
    out = F.when(n.isNotNull(), F.format_string("%dB", n))
    for i, unit in enumerate(units, 1):
        size = 1 << 10 * i
        x = n / F.lit(float(size))
        out = F.when(n >= size, F.when(x < 10, F.format_string(f"%.1f{unit}", x)).otherwise(F.format_string(f"%.0f{unit}", x))).otherwise(out)
    return out


def visible(text: Column) -> Column:
    """Control and format characters replaced, so that a name can't steer a terminal."""
    return F.regexp_replace(text, r"[\p{Cc}\p{Cf}]", "�")


def mode_string(mode: Column) -> Column:
    """drwxr-xr-x of a POSIX mode."""
    kind = F.shiftright(mode, 12).bitwiseAND(F.lit(15))
    letter = F.when(kind == 4, "d").when(kind == 10, "l").when(kind == 2, "c").when(kind == 6, "b").when(kind == 1, "p").when(kind == 12, "s").when(kind == 8, "-").otherwise("?")
    flags = [F.when(mode.bitwiseAND(F.lit(1 << (8 - i))) != 0, "rwx"[i % 3]).otherwise("-") for i in range(9)]
    return F.concat(letter, *flags)


def guid_mixed(raw: Column) -> Column:
    """A GUID's text from 16 bytes whose first three fields are little-endian."""
    h = F.lower(F.hex(raw))

    def byte(i: int) -> Column:
        return F.substring(h, 2 * i + 1, 2)

    order = [(3, 2, 1, 0), (5, 4), (7, 6), (8, 9), (10, 11, 12, 13, 14, 15)]
    return F.concat_ws("-", *(F.concat(*(byte(i) for i in part)) for part in order))


def image_name(name: Column) -> Column:
    """A dataset's name as a file name."""
    return F.regexp_replace(name, "/", "_")
