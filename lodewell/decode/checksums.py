"""Block checksums as four 64-bit words, verdicts, and self-locating checksums."""

from __future__ import annotations

import hashlib

import numpy as np

from .digests import blake3, skein512
from .words import LITTLE, pack64, u64s

# Checksum codes of the format.
NAMES = {0: "inherit", 1: "on", 2: "off", 3: "label", 4: "gang_header", 5: "zilog", 6: "fletcher2", 7: "fletcher4", 8: "sha256", 9: "zilog2", 10: "noparity", 11: "sha512", 12: "skein", 13: "edonr", 14: "blake3"}
CODES = {v: k for k, v in NAMES.items()}
TAIL_MAGIC = 0x0210DA7AB10C7A11
TAIL = 40

OK, MISMATCH, NOT_CHECKED, UNSUPPORTED = "Ok", "Mismatch", "NotChecked", "Unsupported"
_BLOCK = 1 << 16


def fletcher4(data: bytes, endian: str = LITTLE) -> tuple[int, int, int, int]:
    """Four cascaded sums over 32-bit words, modulo 2^64 (numpy's unsigned sums wrap alike)."""
    w = np.frombuffer(data[: len(data) // 4 * 4], "<u4" if endian == LITTLE else ">u4").astype(np.uint64)
    a = b = c = d = np.uint64(0)
    with np.errstate(over="ignore"):
        for at in range(0, len(w), _BLOCK):
            x = w[at : at + _BLOCK]
            one = np.cumsum(x, dtype=np.uint64) + a
            two = np.cumsum(one, dtype=np.uint64) + b
            three = np.cumsum(two, dtype=np.uint64) + c
            d = three.sum(dtype=np.uint64) + d
            a, b, c = one[-1], two[-1], three[-1]
    return int(a), int(b), int(c), int(d)


def fletcher2(data: bytes, endian: str = LITTLE) -> tuple[int, int, int, int]:
    """Two interleaved pairs of sums over 64-bit words."""
    w = np.frombuffer(data[: len(data) // 16 * 16], "<u8" if endian == LITTLE else ">u8").astype(np.uint64).reshape(-1, 2)
    with np.errstate(over="ignore"):
        a = w.sum(axis=0, dtype=np.uint64)
        b = np.cumsum(w, axis=0, dtype=np.uint64).sum(axis=0, dtype=np.uint64)
    return int(a[0]), int(a[1]), int(b[0]), int(b[1])


def _words(digest: bytes) -> tuple[int, int, int, int]:
    return tuple(int.from_bytes(digest[i : i + 8], "big") for i in (0, 8, 16, 24))


def sha256(data: bytes) -> tuple[int, int, int, int]:
    return _words(hashlib.sha256(data).digest())


def sha512_256(data: bytes) -> tuple[int, int, int, int]:
    """SHA-512/256: its digest is read as words of the host's order, unlike SHA-256's."""
    return _native(hashlib.new("sha512_256", data).digest())


def _native(digest: bytes) -> tuple[int, int, int, int]:
    return tuple(int.from_bytes(digest[i : i + 8], "little") for i in (0, 8, 16, 24))


def compute(name: str, data: bytes, endian: str = LITTLE, salt: bytes | None = None) -> tuple[int, int, int, int] | None:
    """The checksum by its name; None for one that isn't built here, or that needs the pool's salt and has none."""
    if name in ("skein", "blake3") and salt is not None:
        return _native(skein512(data, 256, salt) if name == "skein" else blake3(data, salt))
    if name in ("on", "fletcher4"):
        return fletcher4(data, endian)
    if name == "fletcher2":
        return fletcher2(data, endian)
    if name == "sha256":
        return sha256(data)
    if name == "sha512":
        return sha512_256(data)
    return None


def verdict(code: int, data: bytes, expected: tuple[int, ...], endian: str = LITTLE, crypt: bool = False, salt: bytes | None = None) -> str:
    """Ok, Mismatch, NotChecked (nothing was recorded) or Unsupported; an encrypted block keeps its MAC in the last two words."""
    name = NAMES.get(code, "unknown")
    if name in ("off", "noparity"):
        return NOT_CHECKED
    found = compute(name, data, endian, salt)
    if found is None:
        return UNSUPPORTED
    n = 2 if crypt else 4
    return OK if tuple(found[:n]) == tuple(expected[:n]) else MISMATCH


def _sealed(buf: bytes, verifier: tuple[int, ...], endian: str) -> tuple[int, int, int, int]:
    return sha256(buf[:-32] + pack64(*verifier, *[0] * (4 - len(verifier)), endian=endian))


def embedded_verdict(buf: bytes, *verifier: int) -> str:
    """A block that ends in its own checksum, which covers where it stands.

    ``verifier`` is the offset for a label, or (vdev, offset, birth) for a
    gang header. NotChecked if the tail has no magic number.
    """
    if len(buf) < TAIL:
        return NOT_CHECKED
    for endian in ("little", "big"):
        magic, *recorded = u64s(buf, len(buf) - TAIL, 5, endian)
        if magic == TAIL_MAGIC:
            return OK if tuple(recorded) == _sealed(buf, verifier, endian) else MISMATCH
    return NOT_CHECKED


def seal(buf: bytes, *verifier: int) -> bytes:
    """``buf`` with its last 40 bytes replaced by the self-locating checksum."""
    body = buf[:-TAIL] + pack64(TAIL_MAGIC) + bytes(32)
    return body[:-32] + pack64(*_sealed(body, verifier, LITTLE))
