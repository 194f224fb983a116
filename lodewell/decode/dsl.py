"""Dataset directories, datasets, space accounting objects, space maps and indirect mappings."""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from . import Damage
from .blocks import BlkPtr, blkptr
from .words import LITTLE, bits, pack64, u64s

# Features this engine reads fully.
READABLE_FEATURES = (
    "org.open-zfs:large_blocks", "com.delphix:hole_birth", "com.delphix:embedded_data", "com.delphix:extensible_dataset", "org.illumos:lz4_compress", "org.freebsd:zstd_compress",
    "org.zfsonlinux:large_dnode", "org.illumos:sha512", "com.delphix:device_removal", "com.delphix:obsolete_counts", "com.delphix:spacemap_v2", "com.delphix:spacemap_histogram",
    "com.delphix:enabled_txg", "com.delphix:empty_bpobj", "com.joyent:multi_vdev_crash_dump", "org.illumos:skein", "org.openzfs:blake3", "org.openzfs:draid", "com.delphix:bookmarks", "org.zfsonlinux:allocation_classes", "com.datto:resilver_defer", "com.datto:encryption",
)
UNREADABLE_FEATURES = {"org.illumos:edonr": "checksum not built", "org.openzfs:raidz_expansion": "layout not built"}


def feature_support(name: str) -> tuple[str, str | None]:
    """(Yes, None), (No, why) or (Unknown, None)."""
    if name in READABLE_FEATURES:
        return "Yes", None
    return ("No", UNREADABLE_FEATURES[name]) if name in UNREADABLE_FEATURES else ("Unknown", None)


@dataclass(frozen=True)
class Dir:
    creation_time: int
    head_dataset: int
    parent: int
    origin: int
    children: int
    used: int
    props: int
    clones: int


def directory(bonus: bytes, endian: str = LITTLE) -> Dir:
    if len(bonus) < 152:
        raise Damage("dataset directory is short")
    w = u64s(bonus, 0, 19, endian)
    return Dir(w[0], w[1], w[2], w[3], w[4], w[5], w[10], w[18])


def build_directory(creation_time: int, head: int, parent: int, origin: int, children: int, used: int, props: int, clones: int = 0) -> bytes:
    return pack64(creation_time, head, parent, origin, children, used, 0, 0, 0, 0, props, 0, 0, 0, 0, 0, 0, 0, clones).ljust(256, b"\0")


@dataclass(frozen=True)
class Dataset:
    dir_obj: int
    prev_snap: int
    prev_snap_txg: int
    next_snap: int
    snapnames: int
    num_children: int
    creation_time: int
    creation_txg: int
    deadlist: int
    referenced: int
    unique: int
    guid: int
    flags: int
    bp: BlkPtr
    next_clones: int
    props: int
    userrefs: int

    @property
    def snapshot(self) -> bool:
        """A head has no reference from a later one; a snapshot has."""
        return self.num_children > 0

    @property
    def inconsistent(self) -> bool:
        return bool(self.flags & 1)


def dataset(bonus: bytes, endian: str = LITTLE) -> Dataset:
    if len(bonus) < 280:
        raise Damage("dataset is short")
    w = u64s(bonus, 0, 16, endian)
    tail = u64s(bonus.ljust(320, b"\0"), 256, 3, endian)
    return Dataset(w[0], w[1], w[2], w[3], w[4], w[5], w[6], w[7], w[8], w[9], w[12], w[14], w[15], blkptr(bonus, 128, endian), *tail)


def build_dataset(dir_obj: int, creation_time: int, creation_txg: int, guid: int, bp: bytes, *, prev_snap: int = 0, prev_snap_txg: int = 0, next_snap: int = 0, snapnames: int = 0, num_children: int = 0, deadlist: int = 0, referenced: int = 0, unique: int = 0, flags: int = 0, props: int = 0) -> bytes:
    head = pack64(dir_obj, prev_snap, prev_snap_txg, next_snap, snapnames, num_children, creation_time, creation_txg, deadlist, referenced, 0, 0, unique, 0, guid, flags)
    return (head + bp + pack64(0, props, 0)).ljust(320, b"\0")


@dataclass(frozen=True)
class Totals:
    """Byte totals of a pointer list, a pointer tree or a dead list."""

    used: int
    compressed: int
    uncompressed: int


def bpobj(bonus: bytes, endian: str = LITTLE) -> Totals:
    w = u64s(bonus.ljust(32, b"\0"), 0, 4, endian)
    return Totals(w[1], w[2], w[3])


def bptree(bonus: bytes, endian: str = LITTLE) -> Totals:
    return Totals(*u64s(bonus.ljust(40, b"\0"), 16, 3, endian))


def deadlist(bonus: bytes, endian: str = LITTLE) -> Totals:
    return Totals(*u64s(bonus.ljust(24, b"\0"), 0, 3, endian))


@dataclass(frozen=True)
class SpaceStep:
    seq: int
    kind: str
    offset: int
    run: int
    vdev: int | None


def space_log(data: bytes, shift: int, endian: str = LITTLE) -> list[SpaceStep]:
    """An ordered log of alloc and free runs, in one- and two-word entries; markers are dropped."""
    words = u64s(data, 0, len(data) // 8, endian)
    out: list[SpaceStep] = []
    at = 0
    while at < len(words):
        w = words[at]
        top = w >> 62
        if top == 3:
            if at + 1 >= len(words):
                raise Damage("space map ends inside an entry")
            x = words[at + 1]
            vdev = bits(w, 0, 24)
            out.append(SpaceStep(len(out), "free" if x >> 63 else "alloc", bits(x, 0, 63) << shift, (bits(w, 24, 36) + 1) << shift, None if vdev == (1 << 24) - 1 else vdev))
            at += 2
        elif top == 2:  # a marker, or padding
            at += 1
        else:
            out.append(SpaceStep(len(out), "free" if bits(w, 15, 1) else "alloc", bits(w, 16, 47) << shift, (bits(w, 0, 15) + 1) << shift, None))
            at += 1
    return out


def build_space_log(steps: list[tuple[str, int, int]], shift: int, wide: bool = False) -> bytes:
    out = [2 << 62 | 1]
    for kind, offset, run in steps:
        free = kind == "free"
        if wide:
            out += [3 << 62 | ((run >> shift) - 1) << 24 | (1 << 24) - 1, free << 63 | offset >> shift]
        else:
            out.append(offset >> shift << 16 | free << 15 | (run >> shift) - 1)
    return pack64(*out)


@dataclass(frozen=True)
class Mapped:
    """Ranges of a removed device and where they went."""

    src: tuple[int, ...]
    size: tuple[int, ...]
    vdev: tuple[int, ...]
    dst: tuple[int, ...]

    def remap(self, offset: int, size: int) -> list[tuple[int, int, int]]:
        """(vdev, offset, size) pieces in order; the first gap is damage, never a short read."""
        out = []
        i = bisect.bisect_right(self.src, offset) - 1
        while size > 0:
            if i < 0 or i >= len(self.src) or not self.src[i] <= offset < self.src[i] + self.size[i]:
                raise Damage(f"no mapping at {offset}")
            within = offset - self.src[i]
            n = min(size, self.size[i] - within)
            out.append((self.vdev[i], self.dst[i] + within, n))
            offset, size, i = offset + n, size - n, i + 1
        return out


def indirect(data: bytes, count: int, endian: str = LITTLE) -> Mapped:
    """24-byte entries: source offset, then a DVA."""
    if len(data) < 24 * count:
        raise Damage("indirect mapping is short")
    rows = []
    for i in range(count):
        s, a, b = u64s(data, 24 * i, 3, endian)
        rows.append((bits(s, 0, 63) << 9, bits(a, 0, 24) << 9, bits(a, 32, 24), bits(b, 0, 63) << 9))
    rows.sort()
    return Mapped(*(tuple(c) for c in zip(*rows, strict=True))) if rows else Mapped((), (), (), ())


def build_indirect(rows: list[tuple[int, int, int, int]]) -> bytes:
    return b"".join(pack64(src >> 9, vdev << 32 | size >> 9, dst >> 9) for src, size, vdev, dst in rows)
