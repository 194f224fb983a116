"""Block decompression; each result has exactly the logical size or is damage."""

from __future__ import annotations

import zlib

import pyarrow as pa
import zstandard

from . import Damage

# Compression codes of the format.
NAMES = {0: "inherit", 1: "on", 2: "off", 3: "lzjb", 4: "empty", **{4 + n: f"gzip-{n}" for n in range(1, 10)}, 14: "zle", 15: "lz4", 16: "zstd"}
CODES = {v: k for k, v in NAMES.items()}


def lzjb(src: bytes, size: int) -> bytes:
    """A control byte says for each of the next eight items, from its lowest bit, whether it is a match or a literal."""
    out = bytearray()
    at = 0
    while len(out) < size:
        if at >= len(src):
            raise Damage("lzjb: input ends early")
        control, at = src[at], at + 1
        if not control and at + 8 <= len(src) and len(out) + 8 <= size:
            out += src[at : at + 8]
            at += 8
            continue
        for bit in range(8):
            if len(out) >= size:
                break
            if control >> bit & 1:
                if at + 1 >= len(src):
                    raise Damage("lzjb: input ends early")
                length = min((src[at] >> 2) + 3, size - len(out))
                back = (src[at] & 3) << 8 | src[at + 1]
                at += 2
                if not 0 < back <= len(out):
                    raise Damage("lzjb: offset outside output")
                start = len(out) - back
                if back >= length:
                    out += out[start : start + length]
                else:
                    out += (bytes(out[start:]) * (length // back + 1))[:length]
            else:
                if at >= len(src):
                    raise Damage("lzjb: input ends early")
                out.append(src[at])
                at += 1
    return bytes(out)


def zle(src: bytes, size: int, level: int = 64) -> bytes:
    out = bytearray()
    at = 0
    while len(out) < size and at < len(src):
        n = src[at] + 1
        at += 1
        if n <= level:
            out += src[at : at + n]
            at += n
        else:
            out += bytes(n - level)
    if len(out) != size:
        raise Damage("zle: wrong output size")
    return bytes(out)


def _lz4_plain(src: bytes, size: int) -> bytes:
    """By the format's rules alone: the library also wants a block's last match well before its end."""
    out = bytearray()
    at = 0
    while at < len(src):
        token = src[at]
        at += 1
        length = token >> 4
        if length == 15:
            while True:
                if at >= len(src):
                    raise Damage("lz4: input ends early")
                length += src[at]
                at += 1
                if src[at - 1] != 255:
                    break
        if at + length > len(src) or len(out) + length > size:
            raise Damage("lz4: literals run over")
        out += src[at : at + length]
        at += length
        if at == len(src):
            break
        if at + 2 > len(src):
            raise Damage("lz4: input ends early")
        back = src[at] | src[at + 1] << 8
        at += 2
        if not 0 < back <= len(out):
            raise Damage("lz4: offset outside output")
        length = (token & 15) + 4
        if token & 15 == 15:
            while True:
                if at >= len(src):
                    raise Damage("lz4: input ends early")
                length += src[at]
                at += 1
                if src[at - 1] != 255:
                    break
        if len(out) + length > size:
            raise Damage("lz4: match runs over")
        start = len(out) - back
        if back >= length:
            out += out[start : start + length]
        else:
            piece = bytes(out[start:])
            out += (piece * (length // back + 1))[:length]
    if len(out) != size:
        raise Damage("lz4: wrong output size")
    return bytes(out)


_LZ4 = pa.Codec("lz4_raw")


def lz4_block(src: bytes, size: int) -> bytes:
    """One LZ4 block of exactly ``size`` bytes.

    The library does not say how much it wrote, so a block whose result would
    fit into one byte less is damage, too. What the library refuses is decoded
    plainly, which says what is wrong with it.
    """

    def decoded(n: int) -> bytes | None:
        try:
            return _LZ4.decompress(src, decompressed_size=n, asbytes=True)
        except OSError:
            return None

    out = decoded(size) if size > 1 else None
    if out is None:
        return _lz4_plain(src, size)
    if decoded(size - 1) is not None:
        raise Damage("lz4: wrong output size")
    return out


def lz4(src: bytes, size: int) -> bytes:
    """A big-endian length, then one LZ4 block."""
    n = int.from_bytes(src[:4], "big")
    if len(src) < 4 or n + 4 > len(src):
        raise Damage("lz4: length runs past the block")
    return lz4_block(src[4 : 4 + n], size)


def gzip(src: bytes, size: int) -> bytes:
    try:
        out = zlib.decompressobj().decompress(src, size + 1)
    except zlib.error as e:
        raise Damage(f"gzip: {e}") from None
    if len(out) != size:
        raise Damage("gzip: wrong output size")
    return out


def zstd(src: bytes, size: int) -> bytes:
    """Length and version, big-endian, then a frame without its magic number."""
    n = int.from_bytes(src[:4], "big")
    if len(src) < 8 or n + 8 > len(src):
        raise Damage("zstd: length runs past the block")
    try:
        out = zstandard.ZstdDecompressor(format=zstandard.FORMAT_ZSTD1_MAGICLESS).decompress(src[8 : 8 + n], max_output_size=size)
    except zstandard.ZstdError as e:
        raise Damage(f"zstd: {e}") from None
    if len(out) != size:
        raise Damage("zstd: wrong output size")
    return out


def decompress(code: int, src: bytes, size: int) -> bytes:
    name = NAMES.get(code)
    if name in ("off", "empty"):
        if len(src) < size:
            raise Damage("uncompressed block is short")
        return src[:size]
    if name is None or name in ("inherit", "on"):
        raise Damage(f"compression {code} is unknown")
    return {"lzjb": lzjb, "zle": zle, "lz4": lz4, "zstd": zstd}.get(name, gzip)(src, size)


def could_start(name: str, buf: bytes, size: int) -> bool:
    """Cheap test before trying a codec on arbitrary bytes."""
    if name == "lz4":
        return 0 < int.from_bytes(buf[:4], "big") <= min(size, len(buf) - 4)
    if name == "gzip":
        return len(buf) > 1 and buf[0] & 15 == 8 and int.from_bytes(buf[:2], "big") % 31 == 0
    if name == "zstd":
        return 0 < int.from_bytes(buf[:4], "big") <= min(size, len(buf) - 8)
    return True


def compress(name: str, data: bytes) -> bytes:
    """The codecs' simplest valid output, for images that tests write."""
    if name.startswith("gzip"):
        return zlib.compress(data, int(name[5:] or 6))
    if name == "zstd":
        params = zstandard.ZstdCompressionParameters.from_level(3, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=True)
        body = zstandard.ZstdCompressor(compression_params=params).compress(data)
        return len(body).to_bytes(4, "big") + (10405 << 8 | 3).to_bytes(4, "big") + body
    if name == "lz4":
        body = _lz4(data)
        return len(body).to_bytes(4, "big") + body
    if name == "zle":
        out = bytearray()
        at = 0
        while at < len(data):
            run = len(data) - at - len(data[at:].lstrip(b"\0"))
            if run:
                n = min(run, 192)
                out.append(n + 63)
            else:
                n = min(64, len(data) - at, (data[at:] + b"\0").index(0))
                out.append(n - 1)
                out += data[at : at + n]
            at += n
        return bytes(out)
    if name == "lzjb":
        out = bytearray()
        for at in range(0, len(data), 8):
            out += b"\0" + data[at : at + 8]
        return bytes(out)
    raise ValueError(name)


def _lz4(data: bytes) -> bytes:
    """Runs of one repeated byte become matches, all else literals."""
    out = bytearray()

    def more(n: int) -> bytes:
        return b"\xff" * (n // 255) + bytes([n % 255])

    def sequence(literals: bytes, match: int) -> None:
        a, b = len(literals), match - 4
        out.append(min(15, a) << 4 | (min(15, b) if match else 0))
        if a >= 15:
            out.extend(more(a - 15))
        out.extend(literals)
        if match:
            out.extend(b"\x01\x00")
            if b >= 15:
                out.extend(more(b - 15))

    start = at = 0
    while at < len(data) - 12:
        body = data[at : len(data) - 5]
        run = len(body) - len(body.lstrip(body[:1]))
        if run >= 20:
            sequence(data[start : at + 1], run - 1)
            start = at + run
        at += run
    sequence(data[start:], 0)
    return bytes(out)
