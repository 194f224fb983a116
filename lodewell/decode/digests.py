"""BLAKE3 and Skein-512 from their published specifications."""

from __future__ import annotations

import struct

MASK32, MASK64 = (1 << 32) - 1, (1 << 64) - 1

# BLAKE3's initial words and message permutation.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT, KEYED = 1, 2, 4, 8, 16


def _compress(cv: tuple[int, ...], block: bytes, counter: int, length: int, flags: int) -> list[int]:
    m = list(struct.unpack("<16I", block.ljust(64, b"\0")))
    v = [*cv, *IV[:4], counter & MASK32, counter >> 32, length, flags]

    def mix(a: int, b: int, c: int, d: int, x: int, y: int) -> None:
        for word, r1, r2 in ((x, 16, 12), (y, 8, 7)):
            v[a] = (v[a] + v[b] + word) & MASK32
            t = v[d] ^ v[a]
            v[d] = (t >> r1 | t << (32 - r1)) & MASK32
            v[c] = (v[c] + v[d]) & MASK32
            t = v[b] ^ v[c]
            v[b] = (t >> r2 | t << (32 - r2)) & MASK32

    for _ in range(7):
        for i in range(4):
            mix(i, 4 + i, 8 + i, 12 + i, m[2 * i], m[2 * i + 1])
        for i in range(4):
            mix(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, m[8 + 2 * i], m[9 + 2 * i])
        m = [m[p] for p in PERMUTATION]
    return [v[i] ^ v[i + 8] for i in range(8)] + [v[i + 8] ^ cv[i] for i in range(8)]


def blake3(data: bytes, key: bytes | None = None) -> bytes:
    """The 32-byte hash, keyed by 32 bytes if given."""
    base = struct.unpack("<8I", key) if key else IV
    mode = KEYED if key else 0

    def chunk(index: int, last: bool) -> tuple[int, ...]:
        part = data[1024 * index : 1024 * (index + 1)]
        cv, blocks = base, [part[i : i + 64] for i in range(0, len(part), 64)] or [b""]
        for i, b in enumerate(blocks):
            end = i == len(blocks) - 1
            flags = mode | (CHUNK_START if i == 0 else 0) | (CHUNK_END if end else 0) | (ROOT if end and last else 0)
            cv = tuple(_compress(cv, b, index, len(b), flags)[:8])
        return cv

    def tree(first: int, count: int, root: bool) -> tuple[int, ...]:
        if count == 1:
            return chunk(first, root)
        left = 1 << ((count - 1).bit_length() - 1)  # the largest power of two below the count
        both = tree(first, left, False) + tree(first + left, count - left, False)
        return tuple(_compress(base, struct.pack("<16I", *both), 0, 64, mode | PARENT | (ROOT if root else 0))[:8])

    return struct.pack("<8I", *tree(0, max(1, -(-len(data) // 1024)), True))


# Threefish-512 rotations and word permutation, and the key schedule's parity word.
ROTATIONS = ((46, 36, 19, 37), (33, 27, 14, 42), (17, 49, 36, 39), (44, 9, 54, 56), (39, 30, 34, 24), (13, 50, 10, 17), (25, 29, 39, 43), (8, 35, 56, 22))
WORDS = (2, 1, 4, 7, 6, 5, 0, 3)
PARITY = 0x1BD11BDAA9FC1A22
KEY, CONFIG, MESSAGE, OUTPUT = 0, 4, 48, 63


def _threefish(key: list[int], tweak: tuple[int, int], block: list[int]) -> list[int]:
    k = [*key, PARITY]
    for w in key:
        k[8] ^= w
    t = (*tweak, tweak[0] ^ tweak[1])
    v = list(block)
    for d in range(72):
        if d % 4 == 0:
            v = _add_key(v, k, t, d // 4)
        e = []
        for j in range(4):
            a, b, r = v[2 * j], v[2 * j + 1], ROTATIONS[d % 8][j]
            a = (a + b) & MASK64
            e += [a, ((b << r | b >> (64 - r)) & MASK64) ^ a]
        v = [e[p] for p in WORDS]
    return _add_key(v, k, t, 18)


def _add_key(v: list[int], k: list[int], t: tuple[int, ...], s: int) -> list[int]:
    sub = [k[(s + i) % 9] for i in range(8)]
    sub[5] += t[s % 3]
    sub[6] += t[(s + 1) % 3]
    sub[7] += s
    return [(a + b) & MASK64 for a, b in zip(v, sub, strict=True)]


def _ubi(chain: list[int], data: bytes, kind: int) -> list[int]:
    blocks = [data[i : i + 64] for i in range(0, len(data), 64)] or [b""]
    at = 0
    for i, b in enumerate(blocks):
        at += len(b)
        flags = kind << 56 | (1 << 62 if i == 0 else 0) | (1 << 63 if i == len(blocks) - 1 else 0)
        words = list(struct.unpack("<8Q", b.ljust(64, b"\0")))
        chain = [x ^ y for x, y in zip(_threefish(chain, (at, flags), words), words, strict=True)]
    return chain


def skein512(data: bytes, bits: int = 256, key: bytes | None = None) -> bytes:
    """Skein-512 with ``bits`` of output (512 at most), keyed if a key is given."""
    chain = [0] * 8
    if key:
        chain = _ubi(chain, key, KEY)
    chain = _ubi(chain, struct.pack("<IHHQ", 0x33414853, 1, 0, bits) + bytes(16), CONFIG)
    chain = _ubi(chain, data, MESSAGE)
    return struct.pack("<8Q", *_ubi(chain, bytes(8), OUTPUT))[: bits // 8]
