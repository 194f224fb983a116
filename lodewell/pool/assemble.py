"""From label scans to pools: newest config per device tree, leaves bound to members."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..decode import nvlist as nv
from ..decode.draid import Layout
from ..decode.dsl import feature_support
from .members import Label, Member, best_label, flatten_tree, read_label, recovered_base
from .reader import STRIPED, Leaf, Pool, Top

MISSING_CAP = 1024


@dataclass
class Device:
    """A scanned member."""

    index: int
    path: str
    base: int
    labels: list[Label]
    best: Label | None = field(init=False)

    def __post_init__(self) -> None:
        self.best = best_label(self.labels)

    @property
    def config(self) -> nv.NvList | None:
        return self.best.config if self.best else None


def scan(path: str, index: int, refused: list[tuple[int, int]] | None = None) -> Device:
    """All four labels of a member, at the base where it starts."""
    member = Member(path, refused)
    try:
        base = recovered_base(member)
        return Device(index, path, base, [read_label(member, i, base, member.size - base if base else None) for i in range(4)])
    finally:
        member.close()


@dataclass
class Assembly:
    pool: Pool
    hosts: list[dict[str, Any]]
    stale: list[int]
    unaccounted: list[dict[str, Any]]
    removed: list[dict[str, int]]

    def missing_tops(self) -> list[int]:
        """Top devices that no label describes and that were not removed; the first MISSING_CAP."""
        out = []
        for i in range(self.pool.children):
            if i not in self.pool.tops:
                out.append(i)
                if len(out) == MISSING_CAP:
                    break
        return out

    def readable(self) -> bool:
        return not self.missing_tops() and all(t.readable() for t in self.pool.tops.values())


class Twins(ValueError):
    """Two inputs are one disk."""


def assemble(devices: list[Device], refused: dict[int, list[tuple[int, int]]] | None = None) -> list[Assembly]:
    """A pool for each pool GUID among the devices' configs.

    The last device with the greatest txg names the pool; each top device's
    tree is the first with the greatest txg. A device whose leaf no newest tree
    lists is stale. Hosts come with the newest txg that each wrote.
    """
    by_pool: dict[int, list[Device]] = {}
    for d in devices:
        if d.config and (guid := nv.u64(d.config, "pool_guid")) is not None:
            by_pool.setdefault(guid, []).append(d)
    out = []
    for guid, members in by_pool.items():
        newest = max(members, key=lambda d: (d.best.txg, d.index))
        trees: dict[int, tuple[int, nv.NvList]] = {}
        hosts: dict[tuple, int] = {}
        by_leaf: dict[int, Device] = {}
        for d in members:
            tree = nv.child(d.config, "vdev_tree")
            top, txg = (nv.u64(tree, "id") if tree else None), d.best.txg
            if tree is not None and top is not None and (top not in trees or txg > trees[top][0]):
                trees[top] = (txg, tree)
            key = (nv.u64(d.config, "hostid"), nv.text(d.config, "hostname"))
            hosts[key] = max(txg, hosts.get(key, 0))
            leaf = nv.u64(d.config, "guid")
            if leaf in by_leaf:
                raise Twins(f"{by_leaf[leaf].path} and {d.path} are one disk")
            if leaf is not None:
                by_leaf[leaf] = d
        tops, listed = {}, set()
        for top, (_, tree) in sorted(trees.items()):
            rows = flatten_tree(tree)
            inner = {r["parent"] for r in rows}
            leaves = []
            for r in rows:
                if r["n"] in inner or r["guid"] is None:
                    continue
                device = by_leaf.get(r["guid"])
                listed.add(r["guid"])
                leaves.append(Leaf(r["guid"], r["path"], device.index if device else None, device.base if device else 0))
            kind = nv.text(tree, "type") or "disk"
            parity = nv.u64(tree, "nparity") or 0
            spread = None
            if kind == "draid":
                numbers = [nv.u64(tree, f"draid_{k}") or 0 for k in ("ndata", "nspares", "ngroups")]
                spread = Layout(numbers[0], parity, numbers[1], len(leaves), numbers[2])
            tops[top] = Top(top, kind if kind in ("mirror", *STRIPED) else "mirror" if len(leaves) > 1 else "single", nv.u64(tree, "ashift") or 9, parity, leaves, spread)
        features = nv.child(newest.config, "features_for_read") or {}
        judged = [(name, *feature_support(name)) for name in features]
        pool = Pool(guid, nv.text(newest.config, "name") or "", newest.best.txg, tops, [d.path for d in sorted(devices, key=lambda d: d.index)], refused or {}, children=nv.u64(newest.config, "vdev_children") or len(tops))
        out.append(Assembly(pool, [{"hostid": h, "hostname": n, "txg": t} for (h, n), t in hosts.items()], [d.index for leaf, d in by_leaf.items() if leaf not in listed], [{"feature": n, "support": s, "why": w} for n, s, w in judged if s != "Yes"], []))
    return out


def choose(pools: list[Assembly], guid: int | None = None) -> Assembly:
    """The pool with the GUID, or the only one."""
    found = [p for p in pools if guid is None or p.pool.guid == guid]
    if len(found) != 1:
        raise ValueError(f"{len(found)} pools fit; name one by its GUID")
    return found[0]
