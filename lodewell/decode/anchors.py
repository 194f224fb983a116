"""Where a pool member begins, from root pointers and block pointers alone."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import Damage
from .blocks import UBERBLOCK_MAGIC, BlkPtr, uberblock
from .checksums import NAMES as CHECKSUMS
from .checksums import OK, embedded_verdict

LABEL, RING_AT, RING_SIZE = 256 << 10, 128 << 10, 128 << 10
SHIFTS = (10, 11, 12, 13)


def slot_of(txg: int, shift: int) -> int:
    """The ring slot that a transaction group is written to."""
    return txg % (RING_SIZE >> shift)


def slot_offset(label: int, slot: int, shift: int, psize: int | None = None) -> int | None:
    """A slot's offset in its member; labels 2 and 3 need the member's size."""
    if not 0 <= slot < RING_SIZE >> shift:
        return None
    if label < 2:
        return label * LABEL + RING_AT + (slot << shift)
    if psize is None:
        return None
    return psize // LABEL * LABEL - (4 - label) * LABEL + RING_AT + (slot << shift)


@dataclass(frozen=True)
class Anchor:
    at: int
    base: int
    label: int
    slot: int
    shift: int
    txg: int


def anchors(data: bytes, start: int, own: int, psize: int | None = None) -> list[Anchor]:
    """Root pointers in a stretch of a surface whose seal holds for one place of theirs.

    A seal covers the offset within the member, so a root pointer says where
    its member begins. Its slot follows from its transaction group, which
    leaves few places to try.
    """
    words = np.frombuffer(data[: len(data) // 8 * 8], "<u8")
    out = []
    for i in np.flatnonzero(words == UBERBLOCK_MAGIC).tolist():
        at = 8 * i
        if (start + at) % 512 or at >= own:
            continue
        try:
            ub = uberblock(data[at : at + 1024])
        except Damage:
            continue
        for shift in SHIFTS:
            raw = data[at : at + (1 << shift)]
            if ub is None or len(raw) < 1 << shift:
                continue
            slot = slot_of(ub.txg, shift)
            for label in range(4):
                offset = slot_offset(label, slot, shift, psize)
                if offset is not None and embedded_verdict(raw, offset) == OK:
                    out.append(Anchor(start + at, start + at - offset, label, slot, shift, ub.txg))
    return out


def usable_probe(bp: BlkPtr) -> bool:
    """A pointer that can confirm a base: one plain copy, with a checksum that needs no salt."""
    return not bp.embedded and not bp.hole and len(bp.live) == 1 and not bp.live[0].gang and not bp.crypt and CHECKSUMS.get(bp.checksum) in ("fletcher2", "fletcher4", "sha256", "sha512", "on")
