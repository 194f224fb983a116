"""Writes small pools: mirrors, raidz and single disks, with history, volumes and file systems.

It shares only the structure encoders with the readers; layout, allocation and
parity placement of data are written out here.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from ..decode import checksums, compress, crypt, raidz, zap
from ..decode import nvlist as nv
from ..decode.blocks import Dva, build_blkptr, build_dnode, build_embedded, build_objset, build_uberblock
from ..decode.draid import Layout
from ..decode.dsl import build_dataset, build_directory, build_indirect
from ..decode.words import pack64, u64s

LABEL = 256 << 10
HOLE = bytes(128)
SA_MAGIC = 0x2F505A
#: Registered attributes by number, with their sizes; 0 is variable.
ATTRIBUTES = (("ZPL_MODE", 8), ("ZPL_SIZE", 8), ("ZPL_GEN", 8), ("ZPL_UID", 8), ("ZPL_GID", 8), ("ZPL_PARENT", 8), ("ZPL_FLAGS", 8), ("ZPL_ATIME", 16), ("ZPL_MTIME", 16), ("ZPL_CTIME", 16), ("ZPL_CRTIME", 16), ("ZPL_LINKS", 8), ("ZPL_SYMLINK", 0), ("ZPL_DXATTR", 0))
FIXED, SYMLINK, DXATTR = tuple(range(12)), 12, 13


@dataclass
class Volume:
    """Block contents by number; a missing number is a hole."""

    size: int
    blocksize: int
    blocks: dict[int, bytes]
    compression: str = "off"
    checksum: str = "fletcher4"
    key: Key | None = None
    removed: int | None = None  # written as on this device, which was removed since


@dataclass
class Key:
    """An encrypted volume's master key, wrapped by a passphrase."""

    suite: int
    master: bytes
    passphrase: bytes

    def entries(self) -> dict[str, int | bytes]:
        draft = crypt.Facts(self.suite, 77, 1, bytes(range(12)), b"", b"", b"", "passphrase", 500, 9)
        cipher, tag = crypt.wrap(crypt.wrapping_key("passphrase", self.passphrase, draft), draft, self.master, bytes(64))
        n = len(self.master)
        return {"DSL_CRYPTO_SUITE": self.suite, "DSL_CRYPTO_GUID": 77, "DSL_CRYPTO_VERSION": 1, "DSL_CRYPTO_IV": draft.iv, "DSL_CRYPTO_MAC": tag, "DSL_CRYPTO_MASTER_KEY_1": cipher[:n], "DSL_CRYPTO_HMAC_KEY_1": cipher[n:], "keyformat": 3, "pbkdf2iters": 500, "pbkdf2salt": 9}


@dataclass
class Files:
    """Plain files by path; directories come of themselves."""

    files: dict[str, bytes]
    links: dict[str, str] = field(default_factory=dict)
    attributes: bool = False  # described by registered attributes instead of the fixed layout
    xattrs: dict[str, dict[str, bytes]] = field(default_factory=dict)  # such files keep theirs in a spill block
    key: Key | None = None


@dataclass
class Item:
    """A dataset at one transaction group."""

    guid: int
    content: Volume | Files | None
    creation_txg: int
    snapshots: dict[str, tuple[int, int]] = field(default_factory=dict)  # name -> (guid, creation txg)
    props: dict[str, int | str] = field(default_factory=dict)


class Builder:
    def __init__(self, folder: str, kind: str = "mirror", disks: int = 2, nparity: int = 1, size: int = 16 << 20, ashift: int = 9, name: str = "tank", guid: int = 0xA1B2C3D4E5F60718):
        self.spread = Layout(disks - nparity - 1, nparity, 1, disks, 1) if kind == "draid" else None  # one group, one spare
        self.kind, self.nparity, self.size, self.ashift, self.name, self.guid = kind, nparity, size, ashift, name, guid
        self.paths = [os.path.join(folder, f"disk{i}.img") for i in range(disks)]
        self.images = [bytearray(size) for _ in range(disks)]
        self.leaf_guids = [guid + 1 + i for i in range(disks)]
        self.top_guid = guid + 100
        self.next = 1 << ashift
        self.written: dict[bytes, bytes] = {}
        self.rings: list[tuple[int, bytes]] = []
        self.txg = 0
        self.salt: bytes | None = None
        self.moved: dict[int, list[tuple[int, int, int, int]]] = {}  # of removed devices: (source, size, device, offset)

    # -- blocks

    def _place(self, data: bytes, removed: int | None = None) -> Dva:
        """Where the data stands; on a removed device its address there, a megabyte further than it is now."""
        if removed is not None:
            dva = self._place(data)
            rows = self.moved.setdefault(removed, [])
            rows.append((dva.offset + (1 << 20), len(data), 0, dva.offset))
            return Dva(removed, dva.offset + (1 << 20), dva.asize, False)
        sector = 1 << self.ashift
        if self.kind in ("raidz", "draid"):
            n = len(self.images)
            if self.spread:
                asize = self.spread.asize(len(data), self.ashift)
                rows = self.spread.rows(self.next, len(data), self.ashift)
            else:
                asize = raidz.asize(len(data), self.ashift, n, self.nparity)
                rows = [raidz.columns(self.next, len(data), self.ashift, n, self.nparity)]
            dva, at = Dva(0, self.next, asize, False), 0
            for layout in rows:
                body = []
                for c in layout[self.nparity :]:
                    body.append(data[at : at + c.size])
                    at += c.size
                for c, part in zip(layout, raidz.generate(body, self.nparity) + body, strict=True):
                    start = (4 << 20) + c.offset
                    self.images[c.child][start : start + c.size] = part[: c.size].ljust(c.size, b"\0")
        else:
            asize = len(data)
            dva = Dva(0, self.next, asize, False)
            for image in self.images:
                image[(4 << 20) + dva.offset : (4 << 20) + dva.offset + asize] = data
        self.next += -(-asize // sector) * sector
        return dva

    def write(self, data: bytes, type_: int, level: int = 0, compression: str = "off", checksum: str = "fletcher4", embed: bool = False, key: Key | None = None, removed: int | None = None) -> bytes:
        lsize = len(data)
        body = compress.compress(compression, data) if compression != "off" else data
        if embed and len(body) <= 112:
            return build_embedded(body, lsize, compress.CODES[compression], type_, self.txg)
        sector = 1 << self.ashift
        if len(body) >= lsize:
            compression, body = "off", data
        body = body.ljust(-(-len(body) // sector) * sector, b"\0")
        if key is not None:
            salt, iv = os.urandom(8), os.urandom(12)
            own = crypt.block_key(key.master, salt)
            body, tag = crypt.seal_dnodes(key.suite, own, iv, body) if type_ == 10 else crypt.seal(crypt.SUITES[key.suite][0], own, iv, body)
            words = (*checksums.sha256(body)[:2], *u64s(tag, 0, 2))
            raw = bytearray(build_blkptr([self._place(body)], lsize, len(body), compress.CODES[compression], checksums.CODES["sha256"], type_, level, self.txg, 1, words))
            raw[32:48], raw[92:96] = salt + iv[:8], iv[8:]
            raw[55] |= 1 << 5
            return bytes(raw)
        words = checksums.compute(checksum, body, salt=self.salt)
        return build_blkptr([self._place(body, removed)], lsize, len(body), compress.CODES[compression], checksums.CODES[checksum], type_, level, self.txg, 1, words)

    def write_object(self, type_: int, blocks: dict[int, bytes], blocksize: int, *, compression: str = "off", checksum: str = "fletcher4", bonustype: int = 0, bonus: bytes = b"", shift: int = 12, pointers: int = 1, embed: bool = False, key: Key | None = None, removed: int | None = None, spill: bytes = b"") -> bytes:
        """The dnode of an object with these blocks; as many levels as they need."""
        last = max(blocks, default=0)
        level = {i: self.write(b.ljust(blocksize, b"\0"), type_, 0, compression, checksum, embed, key, removed) for i, b in blocks.items()}
        levels, fan = 1, 1 << (shift - 7)
        top = last
        while top >= pointers:
            above = {}
            for i in {i // fan for i in level}:
                raw = b"".join(level.get(i * fan + k, HOLE) for k in range(fan))
                above[i] = self.write(raw, type_, levels, "lz4", "fletcher4")
            level, levels, top = above, levels + 1, top // fan
        return build_dnode(type_, blocksize, levels, shift, last, [level.get(i, HOLE) for i in range(pointers)], bonustype, bonus, spill=spill)

    def write_map(self, type_: int, values: dict, fat: bool = False, key: Key | None = None) -> bytes:
        if fat or any(not isinstance(v, int) for v in values.values()):
            parts = zap.build_fat(values)
            return self.write_object(type_, dict(enumerate(parts)), len(parts[0]), key=key)
        raw = zap.build_micro(values)
        return self.write_object(type_, {0: raw}, len(raw), key=key)

    def write_set(self, kind: int, nodes: dict[int, bytes], key: Key | None = None) -> bytes:
        size = 16 << 10
        blocks: dict[int, bytearray] = {}
        for n, node in nodes.items():
            block = blocks.setdefault(n // 32, bytearray(size))
            block[n % 32 * 512 : n % 32 * 512 + len(node)] = node
        meta = self.write_object(10, {k: bytes(v) for k, v in blocks.items()}, size, compression="off" if key else "lz4", key=key)
        return self.write(build_objset(meta, kind), 11, 0, "lz4")

    # -- contents

    def content(self, item: Item) -> bytes:
        c = item.content
        if c is None:
            return HOLE
        if isinstance(c, Volume):
            data = self.write_object(23, c.blocks or {0: bytes(c.blocksize)}, c.blocksize, compression=c.compression, checksum=c.checksum, key=c.key, removed=c.removed)
            node = bytearray(data)
            node[16:24] = (-(-c.size // c.blocksize) - 1).to_bytes(8, "little") if node[2] > 1 or not c.blocks else node[16:24]
            return self.write_set(3, {1: bytes(node), 2: self.write_map(24, {"size": c.size})})
        return self.write_set(2, self._files(c), c.key)

    def _znode(self, mode: int, size: int, parent: int, links: int = 1) -> bytes:
        words = [1_700_000_000, 5, 1_700_000_001, 6, 1_700_000_002, 7, 1_700_000_003, 8, self.txg, mode, size, parent, links, 0, 0, 0, 1000, 1000]
        return b"".join(w.to_bytes(8, "little") for w in words).ljust(264, b"\0")

    def _described(self, c: Files, path: str, mode: int, size: int, parent: int, links: int, target: bytes = b"") -> dict:
        """The bonus buffer of a file, and its spill block if it has extended attributes."""
        if not c.attributes:
            return {"bonustype": 17, "bonus": self._znode(mode, size, parent, links)}
        values = [mode, size, self.txg, 1000, 1000, parent, 0, *(1_700_000_000, 5, 1_700_000_001, 6, 1_700_000_002, 7, 1_700_000_003, 8), links]
        layout = 3 if target else 2
        head = SA_MAGIC.to_bytes(4, "little") + (layout | 1 << 10).to_bytes(2, "little") + len(target).to_bytes(2, "little")
        out = {"bonustype": 44, "bonus": head + pack64(*values) + target.ljust(-(-len(target) // 8) * 8, b"\0")}
        if path in c.xattrs:
            packed = nv.build(nv.of(**c.xattrs[path]))
            raw = SA_MAGIC.to_bytes(4, "little") + (4 | 1 << 10).to_bytes(2, "little") + len(packed).to_bytes(2, "little") + packed
            out["spill"] = self.write(raw.ljust(-(-len(raw) // 512) * 512, b"\0"), 44, 0, "lz4", key=c.key)
        return out

    def _files(self, c: Files) -> dict[int, bytes]:
        numbers = {"": 3}
        parents: dict[str, dict[str, int]] = {"": {}}
        for path in sorted({*c.files, *c.links}):
            parts = path.split("/")
            for k in range(1, len(parts) + 1):
                here, above = "/".join(parts[:k]), "/".join(parts[: k - 1])
                if here not in numbers:
                    numbers[here] = len(numbers) + 3
                    leaf = k == len(parts)
                    code = 10 if here in c.links else 8 if leaf else 4
                    parents[above][parts[k - 1]] = numbers[here] | code << 60
                    if not leaf:
                        parents[here] = {}
        master = {"VERSION": 4, "ROOT": 3, "DELETE_QUEUE": 2}
        nodes = {2: self.write_map(22, {}, key=c.key)}
        if c.attributes:
            top = len(numbers) + 3
            master |= {"VERSION": 5, "SA_ATTRS": top}
            nodes[top] = self.write_map(45, {"REGISTRY": top + 1, "LAYOUTS": top + 2}, key=c.key)
            nodes[top + 1] = self.write_map(46, {name: n | 1 << 16 | size << 24 for n, (name, size) in enumerate(ATTRIBUTES)}, key=c.key)
            nodes[top + 2] = self.write_map(47, {"2": FIXED, "3": (*FIXED, SYMLINK), "4": (DXATTR,)}, key=c.key)
        nodes[1] = self.write_map(21, master)
        for path, n in numbers.items():
            above = numbers["/".join(path.split("/")[:-1])] if path else 3
            if path in parents:
                raw = zap.build_micro(parents[path])
                nodes[n] = self.write_object(20, {0: raw}, len(raw), key=c.key, **self._described(c, path, 0o40755, len(parents[path]) + 2, above, 2))
            elif path in c.links:
                target = c.links[path].encode()
                own = self._described(c, path, 0o120777, len(target), above, 1, target)
                nodes[n] = self.write_object(19, {} if c.attributes else {0: target}, 512, key=c.key, **own)
            else:
                data = c.files[path]
                blocks = {i: data[i * 4096 : (i + 1) * 4096] for i in range(-(-len(data) // 4096)) if any(data[i * 4096 : (i + 1) * 4096])}
                nodes[n] = self.write_object(19, blocks, 4096, key=c.key, **self._described(c, path, 0o100644, len(data), above, 1))
        return nodes

    # -- versions

    def commit(self, txg: int, timestamp: int, items: dict[str, Item]) -> bytes:
        """A whole new version; ``items`` by path below the pool ('' is the root dataset)."""
        self.txg = txg
        nodes: dict[int, bytes] = {}
        count = [1]

        def number() -> int:
            count[0] += 1
            return count[0]

        def tree(path: str, parent: int) -> int:
            item = items[path]
            me, head, kids = number(), number(), number()
            names = {p[len(path) + 1 if path else 0 :]: p for p in items if p != path and (p.startswith(path + "/") if path else True) and "/" not in p[len(path) + 1 if path else 0 :]}
            props = snaps = 0
            if item.props:
                props = number()
                nodes[props] = self.write_map(15, item.props)
            bp = self.content(item)
            found = {}
            for snap, (guid, born) in item.snapshots.items():
                found[snap] = number()
                nodes[found[snap]] = build_dnode(16, 512, 1, 12, 0, [HOLE], 16, build_dataset(me, timestamp - 5, born, guid, bp, num_children=1, next_snap=head, referenced=4096))
            if found:
                snaps = number()
                nodes[snaps] = self.write_map(14, found)
            dead = number()
            nodes[dead] = build_dnode(50, 512, 1, 12, 0, [HOLE], 51, (512).to_bytes(8, "little") * 3 + bytes(296))
            nodes[kids] = self.write_map(13, {name: tree(p, me) for name, p in names.items()})
            nodes[head] = build_dnode(16, 512, 1, 12, 0, [HOLE], 16, build_dataset(me, 1_600_000_000 + item.creation_txg, item.creation_txg, item.guid, bp, snapnames=snaps, deadlist=dead, referenced=8192))
            bonus = build_directory(1_600_000_000 + item.creation_txg, head, parent, 0, kids, 8192, props)
            nodes[me] = build_dnode(12, 512, 1, 12, 0, [HOLE], 12, bonus)
            if item.content is not None and item.content.key:
                keys = number()
                nodes[keys] = self.write_map(196, item.content.key.entries())
                raw = zap.build_micro({"com.datto:crypto_key_obj": keys})
                nodes[me] = self.write_object(12, {0: raw}, len(raw), bonustype=12, bonus=bonus)
            return me

        root = tree("", 0)
        salted = {"org.illumos:checksum_salt": self.salt} if self.salt else {}
        tops = [nv.of(type=self.kind, id=0, guid=self.top_guid)]
        for vdev, rows in self.moved.items():
            mapping = number()
            nodes[mapping] = self.write_object(196, {0: build_indirect(rows)}, 4096, bonustype=196, bonus=pack64(0, sum(r[1] for r in rows), len(rows), 0))
            tops.append(nv.of(**{"type": "indirect", "id": vdev, "com.delphix:indirect_object": mapping}))
        packed = nv.build(nv.of(name=self.name, vdev_tree=nv.of(type="root", children=tops)))
        config = number()
        nodes[config] = self.write_object(3, {0: packed}, 4096, bonustype=4, bonus=pack64(len(packed)))
        nodes[1] = self.write_map(1, {"root_dataset": root, "config": config} | salted)
        rootbp = self.write_set(1, nodes)
        ub = build_uberblock(txg, timestamp, sum(self.leaf_guids) & ((1 << 64) - 1), rootbp, 1 << max(10, self.ashift))
        self.rings.append((txg, ub))
        return rootbp

    def config(self, disk: int, **extra) -> nv.NvList:
        leaves = [nv.of(type="file", id=i, guid=g, path=f"/dev/{self.name}{i}") for i, g in enumerate(self.leaf_guids)]
        if self.kind == "single":
            tree = nv.of(type="file", id=0, guid=self.leaf_guids[0], path=f"/dev/{self.name}0", ashift=self.ashift, asize=self.size - (4 << 20))
        else:
            tree = nv.of(type=self.kind, id=0, guid=self.top_guid, ashift=self.ashift, asize=self.size - (4 << 20), children=leaves, **({"nparity": self.nparity} if self.nparity and self.kind != "mirror" else {}), **({"draid_ndata": self.spread.data, "draid_nspares": 1, "draid_ngroups": 1} if self.spread else {}))
        base = dict(version=5000, name=self.name, state=0, txg=self.rings[-1][0] if self.rings else 0, pool_guid=self.guid, hostid=0x1234, hostname="here", top_guid=self.top_guid, guid=self.leaf_guids[disk], vdev_children=1, vdev_tree=tree, features_for_read=nv.of(**{"com.delphix:hole_birth": True, "org.illumos:lz4_compress": True}))
        return nv.of(**(base | extra))

    def finish(self, **extra) -> list[str]:
        """Labels and rings on every disk; the images' paths."""
        shift = max(10, self.ashift)
        for i, image in enumerate(self.images):
            front = nv.build(self.config(i, **extra)).ljust(112 << 10, b"\0")
            for at in (0, LABEL, self.size - 2 * LABEL, self.size - LABEL):
                image[at + (16 << 10) : at + (128 << 10)] = checksums.seal(front, at + (16 << 10))
                for txg, ub in self.rings:
                    slot = at + (128 << 10) + (txg % ((128 << 10) >> shift) << shift)
                    image[slot : slot + len(ub)] = checksums.seal(ub, slot)
            with open(self.paths[i], "wb") as f:
                f.write(image)
        return self.paths
