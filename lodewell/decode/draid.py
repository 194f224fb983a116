"""Distributed parity: a block's columns lie on children that a permutation picks by where the block is."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from . import Damage
from .checksums import fletcher4
from .raidz import Column
from .words import MASK

#: Each child's part of a row.
ROW = 16 << 20
SEED = 0xD7A1D5EED

# Fixed values: (permutations, seed, first checksum word of the table) by number of children. Wider devices give theirs as a parameter.
MAPS: dict[int, tuple[int, int, int]] = {
    2: (256, 0x89EF3DABBCC7DE37, 0x433D433D),
    3: (256, 0x89A57F3DE98121B4, 0xBCD8B7B5),
    4: (256, 0xC9EA9EC82340C885, 0x1819D7C69),
    5: (256, 0xF46733B7F4D47DFD, 0x2A1648D74),
    6: (256, 0x88C3C62D8585B362, 0x3D3B0C2C4),
    7: (256, 0x3A65D809B4D1B9D5, 0x55C4183EE),
    8: (256, 0xE98930E3C5D2E90A, 0x6EDFB0329),
    9: (256, 0x5A5430036B982CCB, 0x8CEAF6934),
    10: (256, 0x92BF389E9EADAC74, 0xB26668C09),
    11: (256, 0x74CCEBF1DCF3AE80, 0xDD691358C),
    12: (256, 0x8847E41A1A9F5671, 0x10A0C63C8E),
    13: (256, 0x7481B56DEBF0E637, 0x1424121FE4),
    14: (256, 0x559B8C44065F8967, 0x16AB2FF079),
    15: (256, 0x34C49545A2EE7F01, 0x1A6028EFD6),
    16: (256, 0xB85F4FA81A7698F7, 0x1E95FF5E66),
    17: (256, 0x6353E47B7E47ABA0, 0x21A81FA0FE),
    18: (256, 0xAA549746B1CBB81C, 0x26F02494C9),
    19: (256, 0x892E343F2F31D690, 0x29EB392835),
    20: (256, 0x76914824DB98CC3F, 0x3004F31A7C),
}


def _rotated(x: int, n: int) -> int:
    return (x << n | x >> (64 - n)) & MASK


def generator(a: int, b: int):
    """The xoroshiro128++ sequence."""
    while True:
        yield (_rotated(a + b & MASK, 17) + a) & MASK
        b ^= a
        a, b = _rotated(a, 49) ^ b ^ (b << 21 & MASK), _rotated(b, 28)


def permutations(children: int, count: int, seed: int) -> np.ndarray:
    """``count`` shuffles of the children, each of the one before."""
    numbers = generator(SEED, seed)
    out, row = [], list(range(children))
    for _ in range(count):
        for j in range(children - 1, 0, -1):
            k = next(numbers) % (j + 1)
            row[j], row[k] = row[k], row[j]
        out.append(list(row))
    return np.array(out, np.uint8)


@dataclass
class Layout:
    data: int
    parity: int
    spares: int
    children: int
    groups: int
    maps: dict[int, tuple[int, int, int]] = field(default_factory=lambda: MAPS, repr=False)

    def __post_init__(self) -> None:
        self.width, self.disks = self.data + self.parity, self.children - self.spares
        if not (1 <= self.parity <= 3 and self.data >= 1 and self.groups >= 1 and self.width <= self.disks) or self.width * self.groups % self.disks:
            raise Damage("distributed parity: the numbers of disks don't fit")
        if self.children not in self.maps:
            raise Damage(f"distributed parity: no permutations for {self.children} children")
        count, seed, word = self.maps[self.children]
        self.table = permutations(self.children, count, seed)
        if fletcher4(self.table.tobytes())[0] != word:
            raise Damage("distributed parity: the permutations' checksum is wrong")
        self.group_size = self.width * ROW
        self.slice_size = self.group_size * self.groups // self.disks

    def child(self, permutation: int, column: int) -> int:
        """The child that holds a column: a table row, turned by the rest of the permutation's number."""
        at = permutation % self.table.size
        return int(self.table[at // self.children, column] + at % self.children) % self.children

    def asize(self, psize: int, ashift: int) -> int:
        return -(-psize // (self.data << ashift)) * self.width << ashift

    def _row(self, offset: int, size: int, ashift: int) -> list[Column]:
        group = offset // self.group_size
        permutation, within = divmod(group, self.groups)
        first = group * self.width % self.disks
        row = permutation * (self.width * self.groups // self.disks) + within * self.width // self.disks
        sectors = ROW >> ashift
        physical = sectors * row + (offset >> ashift) % (sectors * self.width) // self.width << ashift
        quotient, rest = divmod(size >> ashift, self.data)
        big = rest + self.parity if rest else 0
        out = []
        for i in range(self.width):
            wrapped = first + i >= self.disks  # columns beyond the last disk go on in the next row
            out.append(Column(self.child(permutation, (first + i) % self.disks), physical + ROW * wrapped, (quotient + (i < big)) << ashift))
        return out

    def rows(self, offset: int, psize: int, ashift: int) -> list[list[Column]]:
        """The columns of a block, parity first; a block that crosses a group has two rows. Trailing columns may be empty."""
        psize = -(-psize >> ashift) << ashift
        edge = (offset // self.group_size + 1) * self.group_size
        if offset + self.asize(psize, ashift) <= edge:
            return [self._row(offset, psize, ashift)]
        here = (edge - offset) // self.width * self.data
        return [self._row(offset, here, ashift), self._row(edge, psize - here, ashift)]

    def spare(self, number: int, physical: int) -> int | None:
        """The child that a distributed spare stands on at a physical offset."""
        return self.child(physical // self.slice_size, self.children - 1 - number) if 0 <= number < self.spares else None
