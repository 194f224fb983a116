"""Endian-aware integers and bit fields."""

from __future__ import annotations

import struct

LITTLE, BIG = "little", "big"
MASK = (1 << 64) - 1


def u64(buf: bytes, at: int, endian: str = LITTLE) -> int | None:
    """An unsigned word, or None past the end."""
    return int.from_bytes(buf[at : at + 8], endian) if 0 <= at and at + 8 <= len(buf) else None


def u64s(buf: bytes, at: int, n: int, endian: str = LITTLE) -> list[int]:
    return list(struct.unpack_from(("<" if endian == LITTLE else ">") + f"{n}Q", buf, at))


def bits(word: int, at: int, n: int) -> int:
    return word >> at & ((1 << n) - 1)


def signed(word: int) -> int:
    """The same 64 bits as a BIGINT."""
    return word - (1 << 64) if word >> 63 else word


def unsigned(word: int) -> int:
    return word & MASK


def pack64(*words: int, endian: str = LITTLE) -> bytes:
    return b"".join((w & MASK).to_bytes(8, endian) for w in words)
