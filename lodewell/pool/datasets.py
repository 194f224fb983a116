"""Maps, the meta object set, the dataset tree, properties and volumes at one root pointer."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..decode import Damage, crypt, zap
from ..decode import nvlist as nv
from ..decode.blocks import BlkPtr, describe_property
from ..decode.dsl import bpobj, bptree, dataset, deadlist, directory, indirect
from .reader import Object, Objects, Reader

MAX_DEPTH = 64
SALT, KEY_MAP = "org.illumos:checksum_salt", "com.datto:crypto_key_obj"


def read_map(obj: Object, lost: list[int] | None = None) -> list[zap.Entry]:
    """All entries of a map; with ``lost`` unreadable leaves are listed there instead of raising."""
    first = obj.read(0)
    kind = zap.kind(first)
    if kind == zap.MICRO:
        return zap.micro(first)
    if kind != zap.HEADER:
        raise Damage("object is no map")
    head = zap.header(first)
    table = list(head.embedded) if head.embedded else []
    if not table:
        raw = b"".join(obj.read(head.table_block + i) for i in range(head.table_blocks))
        table = [int.from_bytes(raw[i : i + 8], "little") for i in range(0, len(raw), 8)]
    out = []
    for blkid in dict.fromkeys(b for b in table if b):
        try:
            out += zap.leaf(obj.read(blkid))
        except Damage:
            if lost is None:
                raise
            lost.append(blkid)
    return out


def numbers(obj: Object) -> dict[str, int]:
    return {e.name: e.number for e in read_map(obj) if e.number is not None}


@dataclass
class Dataset:
    name: str
    object: int
    guid: int | None
    kind: str
    snapshot: bool
    clone: bool
    creation_txg: int | None
    creation_time: int | None
    referenced: int | None
    unique: int | None
    origin_obj: int
    dir_obj: int
    deadlist: int
    props_obj: int
    volsize: int | None = None
    volblocksize: int | None = None
    bp: BlkPtr | None = None
    unknown: list[str] = field(default_factory=list)
    error: str | None = None


@dataclass
class Tree:
    datasets: list[Dataset]
    unread: list[tuple[str, str]]


class Meta:
    """The meta object set of one root pointer."""

    def __init__(self, reader: Reader, rootbp: BlkPtr | bytes):
        self.reader = reader
        self.objects = Objects(reader, rootbp)
        entries = read_map(self.objects.open(1))
        self.directory = {e.name: e.number for e in entries if e.number is not None}
        salt = next((e.data for e in entries if e.name == SALT), None)
        if salt:
            reader.pool.salt = salt
        self._removed()

    def _removed(self) -> None:
        """Mappings of removed devices, which only the pool's own config lists, into the pool.

        A device that can't be mapped stays out, and its pointers unreadable.
        """
        try:
            obj = self.objects.open(self.directory["config"])
            size = int.from_bytes(obj.node.bonus[:8], "little")
            tree = nv.child(nv.parse(obj.bytes(0, size)), "vdev_tree") or {}
        except (Damage, KeyError):
            return
        for top in nv.children(tree, "children"):
            number = nv.u64(top, "com.delphix:indirect_object")
            vdev = nv.u64(top, "id")
            if nv.text(top, "type") != "indirect" or number is None or vdev in self.reader.pool.mappings:
                continue
            try:
                mapped = self.objects.open(number)
                count = int.from_bytes(mapped.node.bonus[16:24], "little")
                self.reader.pool.mappings[vdev] = indirect(mapped.bytes(0, 24 * count), count)
            except Damage:
                continue

    def walk(self, pool: str) -> Tree:
        """Every dataset and snapshot, depth first in the order of the maps; what can't be read is listed."""
        tree = Tree([], [])
        self._dir(self.directory["root_dataset"], pool, tree, set(), 0)
        return tree

    def _dir(self, number: int, name: str, tree: Tree, seen: set[int], depth: int) -> None:
        if number in seen or depth > MAX_DEPTH:
            tree.unread.append((name, "loop" if number in seen else "too deep"))
            return
        seen.add(number)
        try:
            d = directory(self.objects.get(number).bonus)
        except Damage as e:
            tree.unread.append((name, str(e)))
            return
        if d.head_dataset:
            try:
                head = self._dataset(d.head_dataset, name, d.origin, d.props)
                tree.datasets.append(head)
                self._snapshots(head, d.origin, tree)
            except Damage as e:
                tree.unread.append((name, str(e)))
        try:
            children = numbers(self.objects.open(d.children)) if d.children else {}
        except Damage as e:
            tree.unread.append((name + "/", str(e)))
            return
        for child, obj in children.items():
            if not child.startswith("$"):
                self._dir(obj, f"{name}/{child}", tree, seen, depth + 1)

    def _dataset(self, number: int, name: str, origin: int, props: int) -> Dataset:
        ds = dataset(self.objects.get(number).bonus)
        out = Dataset(name, number, ds.guid, "unknown", ds.snapshot, bool(origin) and not ds.snapshot, ds.creation_txg, ds.creation_time, ds.referenced, ds.unique, origin, ds.dir_obj, ds.deadlist, props or ds.props, bp=ds.bp)
        self._contents(out)
        return out

    def _contents(self, out: Dataset) -> None:
        """Kind and volume size; facts that can't be read are named in ``unknown``."""
        if out.bp is None or out.bp.hole:
            out.kind = "empty"
            return
        try:
            objects = Objects(self.reader, out.bp)
        except Damage as e:
            out.unknown += ["kind", "volsize", "volblocksize"]
            out.error = str(e)
            return
        out.kind = {2: "filesystem", 3: "zvol"}.get(objects.set.type, f"type {objects.set.type}")
        if out.kind == "zvol":
            try:
                out.volsize = numbers(objects.open(2)).get("size")
                out.volblocksize = objects.get(1).blocksize
            except Damage as e:
                out.unknown += ["volsize", "volblocksize"]
                out.error = str(e)

    def _snapshots(self, head: Dataset, origin: int, tree: Tree) -> None:
        """Snapshots of a head by creation: names come from its map, order from the transaction groups."""
        raw = dataset(self.objects.get(head.object).bonus)
        if not raw.snapnames:
            return
        try:
            names = numbers(self.objects.open(raw.snapnames))
        except Damage as e:
            tree.unread.append((head.name + "@", str(e)))
            return
        found = []
        for snap, obj in names.items():
            try:
                found.append(self._dataset(obj, f"{head.name}@{snap}", 0, 0))
            except Damage as e:
                tree.unread.append((f"{head.name}@{snap}", str(e)))
        tree.datasets += sorted(found, key=lambda s: s.creation_txg or 0)

    def properties(self, ds: Dataset) -> list[dict]:
        """(name, number, text, meaning) of a dataset's own properties."""
        if not ds.props_obj:
            return []
        out = []
        for e in read_map(self.objects.open(ds.props_obj)):
            out.append({"name": e.name, "number": e.number, "text": e.text, "meaning": describe_property(e.name, e.number) if e.number is not None else None})
        return out

    def encryption(self, dir_obj: int) -> crypt.Facts | None:
        """The key facts of a dataset directory; None if it is not encrypted.

        The key's form and its derivation stand with the encryption root.
        """
        try:
            own = numbers(self.objects.open(dir_obj))
        except Damage:
            return None
        if KEY_MAP not in own:
            return None

        def entries(number: int) -> dict[str, object]:
            return {e.name: e.number if e.number is not None else e.data for e in read_map(self.objects.open(number))}

        found = entries(own[KEY_MAP])
        root = found.get("DSL_CRYPTO_ROOT_DDOBJ", dir_obj)
        if root != dir_obj:
            above = numbers(self.objects.open(root))
            if KEY_MAP in above:
                found |= {k: v for k, v in entries(above[KEY_MAP]).items() if k in ("keyformat", "pbkdf2iters", "pbkdf2salt")}
        return crypt.facts(found)

    def unlock(self, ds: Dataset, spec: str) -> Reader:
        """A reader that decrypts a dataset with the key that ``spec`` gives."""
        facts = self.encryption(ds.dir_obj)
        if facts is None:
            return self.reader
        kind, material = crypt.from_spec(spec)
        return Reader(self.reader.pool, (facts.suite, crypt.unwrap(crypt.wrapping_key(kind, material, facts), facts)))

    def pending(self, datasets: list[Dataset]) -> dict[str, int | None]:
        """Space that is being given back: deferred frees, destroys under way, and distinct dead lists."""

        def total(key: str, decode) -> int | None:
            if key not in self.directory:
                return 0
            try:
                return decode(self.objects.get(self.directory[key]).bonus).used
            except Damage:
                return None

        lists = 0
        for number in {d.deadlist for d in datasets if d.deadlist}:
            try:
                lists += deadlist(self.objects.get(number).bonus).used
            except Damage:
                pass
        return {"free": total("free_bpobj", bpobj), "deferred": total("sync_bplist", bpobj), "destroying": total("bptree_obj", bptree), "deadlists": lists}


def volume(reader: Reader, ds: Dataset) -> tuple[Object, int]:
    """A volume's data object and its size."""
    if ds.kind != "zvol" or ds.volsize is None:
        raise Damage(f"{ds.name} is no readable volume")
    return Objects(reader, ds.bp).open(1), ds.volsize
