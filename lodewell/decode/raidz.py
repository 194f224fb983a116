"""Striped-parity layout and reconstruction over GF(2^8)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import Damage

POLYNOMIAL = 0x11D

_EXP = np.zeros(512, np.uint8)
_LOG = np.zeros(256, np.int64)
_x = 1
for _i in range(255):
    _EXP[_i] = _EXP[_i + 255] = _x
    _LOG[_x] = _i
    _x = _x << 1 ^ (POLYNOMIAL if _x & 0x80 else 0)
_A = np.arange(256)
#: Product of every two field elements.
PRODUCT = np.where((_A[:, None] == 0) | (_A[None, :] == 0), 0, _EXP[(_LOG[_A][:, None] + _LOG[_A][None, :]) % 255]).astype(np.uint8)


def multiply(a: int, b: int) -> int:
    return int(PRODUCT[a, b])


def power(base: int, n: int) -> int:
    """``base`` to the n; n may be any integer for a non-zero base."""
    return int(_EXP[_LOG[base] * n % 255]) if base else int(n == 0)


def inverse(a: int) -> int:
    if not a:
        raise ZeroDivisionError("zero has no inverse")
    return int(_EXP[(255 - _LOG[a]) % 255])


@dataclass(frozen=True)
class Column:
    child: int
    offset: int
    size: int


def columns(offset: int, psize: int, ashift: int, children: int, parity: int) -> list[Column]:
    """The columns of a block, parity first; sizes are in whole sectors."""
    sector = 1 << ashift
    start, sectors = offset >> ashift, -(-psize >> ashift)
    first, row = start % children, start // children << ashift
    quotient, rest = divmod(sectors, children - parity)
    big = rest + parity if rest else 0
    used = big if not quotient else children
    out = []
    for c in range(used):
        child, at = first + c, row
        if child >= children:
            child, at = child - children, at + sector
        out.append(Column(child, at, (quotient + (c < big)) << ashift))
    if parity == 1 and used > 1 and offset & 1 << 20:  # single parity alternates its column by megabyte
        a, b = out[0], out[1]
        out[0], out[1] = Column(b.child, b.offset, a.size), Column(a.child, a.offset, b.size)
    return out


def asize(psize: int, ashift: int, children: int, parity: int) -> int:
    """Bytes a block takes with its parity and padding."""
    sectors = -(-psize >> ashift)
    sectors += parity * -(-sectors // (children - parity))
    return -(-sectors // (parity + 1)) * (parity + 1) << ashift


def _rows(data: list[bytes]) -> np.ndarray:
    width = max(map(len, data), default=0)
    return np.stack([np.frombuffer(d.ljust(width, b"\0"), np.uint8) for d in data])


def generate(data: list[bytes], parity: int) -> list[bytes]:
    """P, Q, R: parity p weighs column i of n by (2^p)^(n-1-i)."""
    d = _rows(data)
    n = len(d)
    return [np.bitwise_xor.reduce([PRODUCT[power(1 << p, n - 1 - i)][d[i]] for i in range(n)]).tobytes() for p in range(parity)]


def reconstruct(data: list[bytes | None], parity: list[bytes | None], sizes: list[int]) -> list[bytes]:
    """Missing data columns (None) solved from as many present parity columns."""
    missing = [i for i, d in enumerate(data) if d is None]
    present = [p for p, x in enumerate(parity) if x is not None]
    if len(missing) > len(present):
        raise Damage("more columns are missing than parity can rebuild")
    if not missing:
        return [d for d in data if d is not None]
    n, width = len(data), max(sizes)
    known = [(i, np.frombuffer(d.ljust(width, b"\0"), np.uint8)) for i, d in enumerate(data) if d is not None]
    use = present[: len(missing)]
    matrix = [[power(1 << p, n - 1 - i) for i in missing] for p in use]
    right = []
    for p in use:
        x = np.frombuffer(parity[p].ljust(width, b"\0"), np.uint8).copy()
        for i, d in known:
            x ^= PRODUCT[power(1 << p, n - 1 - i)][d]
        right.append(x)
    for c in range(len(missing)):  # Gauss-Jordan over the field
        pivot = next((r for r in range(c, len(use)) if matrix[r][c]), None)
        if pivot is None:
            raise Damage("parity equations are singular")
        matrix[c], matrix[pivot], right[c], right[pivot] = matrix[pivot], matrix[c], right[pivot], right[c]
        k = inverse(matrix[c][c])
        matrix[c], right[c] = [multiply(k, v) for v in matrix[c]], PRODUCT[k][right[c]]
        for r in range(len(use)):
            if r != c and matrix[r][c]:
                k = matrix[r][c]
                matrix[r] = [v ^ multiply(k, w) for v, w in zip(matrix[r], matrix[c], strict=True)]
                right[r] = right[r] ^ PRODUCT[k][right[c]]
    out = list(data)
    for c, i in enumerate(missing):
        out[i] = right[c].tobytes()[: sizes[i]]
    return out
