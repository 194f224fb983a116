"""Read-only members: positioned reads, read windows, salvage around refused bytes, label scans."""

from __future__ import annotations

import os
from collections import OrderedDict
from dataclasses import dataclass, field
from typing import Any

from ..decode import Damage, media
from ..decode import nvlist as nv
from ..decode.blocks import Uberblock, uberblock
from ..decode.checksums import OK, embedded_verdict

LABEL = 256 << 10
LABELS = 4
CONFIG_AT, CONFIG_SIZE = 16 << 10, 112 << 10
RING_AT, RING_SIZE = 128 << 10, 128 << 10
DATA_AT = 4 << 20  # offsets of data pointers count from here
WINDOW, WINDOW_BYTES = 128 << 10, 64 << 20


class Refused(OSError):
    """Bytes that the medium, or an imager's map, does not give."""


class Member:
    """A file or device opened read-only; it has no way to write."""

    def __init__(self, path: str, refused: list[tuple[int, int]] | None = None):
        self.path, self.refused = path, refused or []
        self.fd = os.open(path, os.O_RDONLY)
        self.size = os.lseek(self.fd, 0, os.SEEK_END)
        self._windows: OrderedDict[int, bytes] = OrderedDict()

    def close(self) -> None:
        os.close(self.fd)

    def read(self, offset: int, length: int) -> bytes:
        """Exactly ``length`` bytes, or Refused; short reads past the end are refused too."""
        if offset < 0 or offset + length > self.size:
            raise Refused(f"{offset}+{length} lies outside {self.path}")
        for a, b in self.refused:
            if a < offset + length and offset < b:
                raise Refused(f"{a}-{b} of {self.path} was not read by the imager")
        first, last = offset // WINDOW, (offset + length - 1) // WINDOW if length else offset // WINDOW
        if first == last and length:
            window = self._windows.get(first)
            if window is None:
                window = os.pread(self.fd, WINDOW, first * WINDOW)
                self._windows[first] = window
                if len(self._windows) * WINDOW > WINDOW_BYTES:
                    self._windows.popitem(last=False)
            else:
                self._windows.move_to_end(first)
            return window[offset - first * WINDOW : offset - first * WINDOW + length]
        return os.pread(self.fd, length, offset)

    def salvage(self, offset: int, length: int, sector: int = 512) -> tuple[bytes, list[tuple[int, int]]]:
        """What can be read, zeros elsewhere, and the bad (start, length) ranges within it."""
        try:
            return self.read(offset, length), []
        except OSError:
            pass
        out, bad = bytearray(length), []
        at = 0
        while at < length:
            n = min(sector - (offset + at) % sector, length - at)
            try:
                out[at : at + n] = self.read(offset + at, n)
            except OSError:
                if bad and sum(bad[-1]) == at:
                    bad[-1] = (bad[-1][0], bad[-1][1] + n)
                else:
                    bad.append((at, n))
            at += n
        return bytes(out), bad


def kind_of(path: str) -> str:
    """file, device, other or missing, by its metadata alone."""
    import stat

    try:
        mode = os.stat(path).st_mode
    except OSError:
        return "missing"
    return "file" if stat.S_ISREG(mode) else "device" if stat.S_ISBLK(mode) or stat.S_ISCHR(mode) else "other"


def label_offsets(size: int) -> list[int]:
    whole = size // LABEL * LABEL
    return [0, LABEL, whole - 2 * LABEL, whole - LABEL]


@dataclass
class Slot:
    index: int
    status: str
    reason: str | None
    ub: Uberblock | None


@dataclass
class Label:
    index: int
    offset: int
    verdict: str
    config: nv.NvList | None
    reason: str | None
    slots: list[Slot] = field(default_factory=list)

    @property
    def txg(self) -> int:
        return (nv.u64(self.config, "txg") or 0) if self.config else 0


def slot_shift(config: nv.NvList | None) -> int:
    """log2 of a ring slot: the sector size, 1 KiB at least and 8 KiB at most."""
    tree = nv.child(config, "vdev_tree") if config else None
    ashift = (nv.u64(tree, "ashift") or 0) if tree else 0
    return min(13, max(10, ashift))


def read_label(member: Member, index: int, base: int = 0, size: int | None = None) -> Label:
    """One label; a damaged part is a status and a reason, never an exception."""
    offset = label_offsets((member.size if size is None else size) - (base if size is None else 0))[index]
    config, reason, verdict = None, None, "Unreadable"
    try:
        raw = member.read(base + offset + CONFIG_AT, CONFIG_SIZE)
        verdict = embedded_verdict(raw, offset + CONFIG_AT)
        config = nv.parse(raw)
    except (Damage, OSError) as e:
        reason = str(e)
    label = Label(index, offset, verdict, config, reason)
    shift = slot_shift(config)
    for k in range(RING_SIZE >> shift):
        at = offset + RING_AT + (k << shift)
        try:
            raw = member.read(base + at, 1 << shift)
            ub = uberblock(raw)
            if ub is None:
                label.slots.append(Slot(k, "empty", None, None))
                continue
            good = embedded_verdict(raw, at) == OK
            label.slots.append(Slot(k, "verified" if good else "corrupt", None if good else "checksum", ub))
        except (Damage, OSError) as e:
            label.slots.append(Slot(k, "corrupt", str(e), None))
    return label


def best_label(labels: list[Label]) -> Label | None:
    """A verified config before an unverified one, then the highest txg; the last index wins ties."""
    known = [x for x in labels if x.config is not None]
    return max(known, key=lambda x: (x.verdict == OK, x.txg, x.index), default=None)


def recovered_base(member: Member) -> int:
    """Where the pool member starts: 0, or the first partition at which a label verifies."""

    def verified(base: int) -> bool:
        if base + LABEL > member.size:
            return False
        return any(read_label(member, i, base).verdict == OK for i in (0, 1))

    if verified(0):
        return 0
    try:
        found = media.partitions(member.read, member.size)
    except OSError:
        found = []
    return next((b for b in media.base_candidates(found) if verified(b)), 0)


def flatten_tree(tree: nv.NvList, parent: int | None = None, depth: int = 0, out: list[dict[str, Any]] | None = None) -> list[dict[str, Any]]:
    """The device tree as rows in walk order: n, parent, depth, kind, id, guid, path, ashift, nparity."""
    out = [] if out is None else out
    n = len(out)
    out.append({"n": n, "parent": parent, "depth": depth, "kind": nv.text(tree, "type"), "id": nv.u64(tree, "id"), "guid": nv.u64(tree, "guid"), "path": nv.text(tree, "path"), "ashift": nv.u64(tree, "ashift"), "nparity": nv.u64(tree, "nparity")})
    for c in nv.children(tree, "children"):
        if depth < 8:
            flatten_tree(c, n, depth + 1, out)
    return out
