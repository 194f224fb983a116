"""Recognising objects on a raw surface: cheap head test, ordered structural checks, profile, score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from . import Damage
from .blocks import BlkPtr, Dnode, dnode
from .checksums import NAMES as CHECKSUMS
from .compress import NAMES as COMPRESSIONS

SLOT = 512
LARGEST_BLOCK = 16 << 20
#: Types up to here may be known to newer writers; the top bit marks the new encoding.
LAST_TYPE = 60
#: Births further apart than this never belonged together.
BIRTH_SPREAD = 4096

# Reason names, structural ones in the order they are tested.
STRUCTURAL = ("free", "dnode_type", "indblkshift", "nlevels", "nblkptr", "datablkszsec", "bonuslen", "no_blocks", "checksum_code", "compress_code", "blkptr")
PROFILE = ("profile_type", "profile_volblocksize", "profile_levels", "profile_txg", "profile_size")


def head_reasons(chunk: np.ndarray) -> np.ndarray:
    """Index into STRUCTURAL of the first failing head test of every slot, -1 where none fails.

    ``chunk`` holds whole slots. Four bytes settle nearly every slot; all
    slots of a chunk are tested at once, the cheapest test first.
    """
    slots = chunk.reshape(-1, SLOT)
    kind, shift, levels, pointers = (slots[:, k] for k in range(4))
    tests = [kind == 0, (kind > LAST_TYPE) & (kind < 0x80), (shift < 9) | (shift > 17), (levels < 1) | (levels > 7), (pointers < 1) | (pointers > 3)]
    return np.select(tests, range(len(tests)), -1)


def _bad_pointer(b: BlkPtr) -> bool:
    if not 0 < b.lsize <= LARGEST_BLOCK or b.psize > b.lsize:
        return True
    return not b.embedded and (b.psize == 0 or b.birth == 0 or b.dva[0].asize == 0)


def plausible_indirect(pointers: list[BlkPtr], birth: int) -> bool:
    """An indirect block has live pointers, all of them plausible and none younger than itself."""
    live = [p for p in pointers if not p.hole]
    return bool(live) and not any(_bad_pointer(p) or (birth and p.birth > birth) for p in live)


def _live(d: Dnode) -> list[BlkPtr]:
    return [p for p in d.blkptr if not p.hole]


#: (reason, failing test) beyond the head, in order.
BODY: tuple[tuple[str, Callable[[Dnode], bool]], ...] = (
    ("datablkszsec", lambda d: not 0 < d.blocksize <= LARGEST_BLOCK or (d.maxblkid > 0 and d.blocksize & (d.blocksize - 1) != 0)),
    ("no_blocks", lambda d: not _live(d) and not d.bonus),
    ("checksum_code", lambda d: any(p.checksum not in CHECKSUMS for p in _live(d))),
    ("compress_code", lambda d: any(p.compression not in COMPRESSIONS for p in _live(d))),
    ("blkptr", lambda d: any(map(_bad_pointer, _live(d)))),
)


def judge(slot: bytes) -> tuple[Dnode | None, str | None]:
    """(object, None), or (None, the first failing reason)."""
    head = head_reasons(np.frombuffer(slot[:SLOT], np.uint8))[0]
    if head >= 0:
        return None, STRUCTURAL[head]
    try:
        d = dnode(slot)
    except Damage:
        return None, "bonuslen"
    return next(((None, name) for name, failed in BODY if failed(d)), (d, None))


@dataclass(frozen=True)
class Profile:
    """What is known about the object that is looked for; an absent field filters nothing."""

    type: int | None = None
    volblocksize: int | None = None
    levels: int | None = None
    txg: tuple[int, int] | None = None
    size: tuple[int, int] | None = None

    def misses(self, d: Dnode) -> list[str]:
        """All failing fields, in fixed order."""
        facts = (self.type, d.type), (self.volblocksize, d.blocksize), (self.levels, d.nlevels)
        out = [name for name, (want, have) in zip(PROFILE, facts, strict=False) if want is not None and want != have]
        ranges = (self.txg, birth(d)), (self.size, d.size)
        return out + [name for name, (want, have) in zip(PROFILE[3:], ranges, strict=True) if want is not None and not want[0] <= have <= want[1]]


def birth(d: Dnode) -> int:
    return max((p.birth for p in _live(d)), default=0)


def score(d: Dnode) -> float:
    """Half for pointers that address something, a quarter each for births that agree and a shape that can hold the blocks."""
    live = _live(d)
    if not live:
        return 0.0
    addressable = sum(p.embedded or (p.dva[0].asize > 0 and p.lsize > 0) for p in live) / len(live)
    births = [p.birth for p in live]
    together = 0.0 if 0 in births else 1.0 if max(births) - min(births) <= BIRTH_SPREAD else 0.5
    fan = 1 << max(0, d.indblkshift - 7)
    holds = d.nblkptr * fan ** min(6, d.nlevels - 1) > d.maxblkid
    return 0.5 * addressable + 0.25 * together + 0.25 * holds


def rank(structure: float, agreement: float | None, matched: bool) -> float:
    """Disjoint bands: 0.55 to 1 for a full profile match, 0 to 0.45 otherwise."""
    base = structure if agreement is None else (structure + agreement) / 2
    base = min(1.0, max(0.0, base))
    return 0.55 + 0.45 * base if matched else 0.45 * base
