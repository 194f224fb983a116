"""Name/value maps on disk: micro and fat forms."""

from __future__ import annotations

from dataclasses import dataclass

from . import Damage
from .words import LITTLE, pack64, u64, u64s

MICRO, HEADER, LEAF = (1 << 63) + 3, (1 << 63) + 1, 1 << 63
HEADER_MAGIC, LEAF_MAGIC = 0x2F52AB2AB, 0x2AB1EAF
CHUNK = 24
ENTRY, ARRAY, END = 252, 251, 0xFFFF


@dataclass(frozen=True)
class Entry:
    raw_name: bytes
    cd: int
    ints: tuple[int, ...] = ()
    data: bytes = b""
    width: int = 8

    @property
    def name(self) -> str:
        return self.raw_name.decode("utf-8", "replace")

    @property
    def number(self) -> int | None:
        return self.ints[0] if self.width == 8 and len(self.ints) == 1 else None

    @property
    def text(self) -> str | None:
        return self.data.rstrip(b"\0").decode("utf-8", "replace") if self.width == 1 else None


def micro(buf: bytes, endian: str = LITTLE) -> list[Entry]:
    out = []
    for at in range(64, len(buf) - 63, 64):
        name = buf[at + 14 : at + 64].split(b"\0", 1)[0]
        if name:
            out.append(Entry(name, int.from_bytes(buf[at + 8 : at + 12], endian), (u64(buf, at, endian),)))
    return out


def kind(buf: bytes, endian: str = LITTLE) -> int | None:
    return u64(buf, 0, endian)


@dataclass(frozen=True)
class Header:
    table_block: int
    table_blocks: int
    shift: int
    leaves: int
    entries: int
    embedded: tuple[int, ...]


def header(buf: bytes, endian: str = LITTLE) -> Header:
    w = u64s(buf, 0, 11, endian)
    if w[0] != HEADER or w[1] != HEADER_MAGIC:
        raise Damage("not a fat map header")
    half = len(buf) // 2
    embedded = tuple(u64s(buf, half, half // 8, endian)) if w[2] == 0 else ()
    return Header(w[2], w[3], w[4], w[8], w[9], embedded)


def leaf(buf: bytes, endian: str = LITTLE) -> list[Entry]:
    """All entries of a leaf block, in chunk order."""
    if u64(buf, 0, endian) != LEAF or int.from_bytes(buf[24:28], endian) != LEAF_MAGIC:
        raise Damage("not a map leaf")
    shift = len(buf).bit_length() - 1
    start = 48 + 2 * (1 << (shift - 5))
    count = (len(buf) - start) // CHUNK

    def chunk(i: int) -> bytes:
        if not 0 <= i < count:
            raise Damage("map chunk outside its leaf")
        return buf[start + i * CHUNK : start + (i + 1) * CHUNK]

    def array(i: int, size: int) -> bytes:
        out = b""
        for _ in range(count):
            if len(out) >= size:
                break
            c = chunk(i)
            if c[0] != ARRAY:
                raise Damage("map array chunk is not one")
            out += c[1:22]
            i = int.from_bytes(c[22:24], endian)
        if len(out) < size:
            raise Damage("map array ends early")
        return out[:size]

    out = []
    for i in range(count):
        c = chunk(i)
        if c[0] != ENTRY:
            continue
        width = c[1]
        name_at, name_n, value_at, value_n = (int.from_bytes(c[k : k + 2], endian) for k in (4, 6, 8, 10))
        cd = int.from_bytes(c[12:16], endian)
        if width not in (1, 2, 4, 8):
            raise Damage("map value has an odd width")
        raw = array(value_at, width * value_n)
        name = array(name_at, name_n).rstrip(b"\0")
        ints = tuple(int.from_bytes(raw[k : k + width], "big") for k in range(0, len(raw), width)) if width > 1 else ()
        out.append(Entry(name, cd, ints, raw if width == 1 else b"", width))
    return out


def build_micro(values: dict[str, int], size: int | None = None) -> bytes:
    body = b"".join(pack64(v) + bytes(6) + k.encode().ljust(50, b"\0") for k, v in values.items())
    size = size or max(512, 1 << (64 + len(body) - 1).bit_length())
    return (pack64(MICRO, 7, 0) + bytes(40) + body).ljust(size, b"\0")


def build_fat(values: dict[str, int | str | bytes | list[int] | tuple[int, ...]], block: int = 4096) -> list[bytes]:
    """A header with an embedded table and one leaf; enough for what tests write. Tuples are 16-bit numbers."""
    shift = block.bit_length() - 1
    hashes = 1 << (shift - 5)
    chunks: list[bytes] = []

    def array(data: bytes) -> int:
        first = len(chunks)
        parts = [data[i : i + 21] for i in range(0, len(data), 21)] or [b""]
        for k, p in enumerate(parts):
            nxt = END if k == len(parts) - 1 else first + k + 1
            chunks.append(bytes([ARRAY]) + p.ljust(21, b"\0") + nxt.to_bytes(2, "little"))
        return first

    for name, value in values.items():
        raw_name = name.encode() + b"\0"
        if isinstance(value, bytes):
            width, raw = 1, value
        elif isinstance(value, str):
            width, raw = 1, value.encode() + b"\0"
        elif isinstance(value, tuple):
            width, raw = 2, b"".join(v.to_bytes(2, "big") for v in value)
        else:
            width, raw = 8, b"".join(v.to_bytes(8, "big") for v in (value if isinstance(value, list) else [value]))
        at = len(chunks)
        chunks.append(b"")
        n, v = array(raw_name), array(raw)
        chunks[at] = bytes([ENTRY, width]) + END.to_bytes(2, "little") + b"".join(x.to_bytes(2, "little") for x in (n, len(raw_name), v, len(raw) // width)) + bytes(4) + bytes(8)
    body = (pack64(LEAF, 0, 0) + LEAF_MAGIC.to_bytes(4, "little")).ljust(48, b"\0") + b"\xff" * (2 * hashes) + b"".join(chunks)
    if len(body) > block:
        raise ValueError("too many entries for one leaf")
    table = pack64(*[1] * (block // 16))
    head = (pack64(HEADER, HEADER_MAGIC, 0, 0, (block // 16).bit_length() - 1, 0, 0, 2, 1, len(values), 0)).ljust(block // 2, b"\0") + table
    return [head, body.ljust(block, b"\0")]
