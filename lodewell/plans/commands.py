"""The questions a pool is asked, as DataFrames: scan, list, dump, timeline, carve, files, report."""

from __future__ import annotations

import hashlib
import json
import os
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..decode import Damage, anchors, carve, compress
from ..decode import nvlist as nv
from ..decode.blocks import Uberblock, blkptr, object_type, objset
from ..decode.checksums import OK, verdict
from ..decode.words import signed
from ..operators import classify, custody, hierarchy, history, integrity
from ..pool import assemble as topology
from ..pool import datasets as dsl
from ..pool.files import Filesystem
from ..pool.members import DATA_AT, Member, flatten_tree
from ..pool.reader import Object, Objects, Reader
from ..runtime import write_table
from ..sources import blocks as block_source
from ..sources import evidence, image

# Exit codes.
EXIT = {"ok": 0, "usage": 1, "unreadable": 2, "unrecoverable": 3, "partial": 4, "refused": 5, "interrupted": 6, "medium": 7}


def _frame(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def _tasks(spark: SparkSession, items: list[Any], fn, schema: str) -> DataFrame:
    """One task per item: ``fn(item)`` gives rows (tuples in schema order)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = _parse_datatype_string(schema)
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("item").to_pylist():
                rows = list(fn(pickle.loads(raw)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    given = spark.createDataFrame([(i, pickle.dumps(x)) for i, x in enumerate(items)], "n long, item binary")
    dealt = given.repartitionByRange(max(1, len(items)), "n") if len(items) > 1 else given
    return dealt.select("item").mapInArrow(run, target)


# -- scan


@dataclass
class Scanned:
    """What a scan of members found: the devices, the pools, and tables of every part."""

    devices: list[topology.Device]
    pools: list[topology.Assembly]
    tables: dict[str, DataFrame]


def scan(spark: SparkSession, paths: list[str], refused: dict[int, list[tuple[int, int]]] | None = None) -> Scanned:
    """Labels, root pointers, device trees, pools and hosts of the members; one task a member."""

    def one(item):
        i, path, bad = item
        yield (i, pickle.dumps(topology.scan(path, i, bad)))

    found = _tasks(spark, [(i, p, (refused or {}).get(i)) for i, p in enumerate(paths)], one, "member int, device binary").collect()  # labels only
    devices = [pickle.loads(r["device"]) for r in sorted(found, key=lambda r: r["member"])]
    pools = topology.assemble(devices, refused)
    labels, slots, leaves = [], [], []
    for d in devices:
        for x in d.labels:
            count = {s: sum(k.status == s for k in x.slots) for s in ("empty", "verified", "corrupt")}
            labels.append((d.index, d.path, d.base, x.index, x.offset, x.verdict, x.txg if x.config else None, nv.to_json(x.config) if x.config else None, x.reason, len(x.slots), count["verified"], count["empty"], count["corrupt"]))
            for s in x.slots:
                if s.status != "empty":
                    u = s.ub
                    slots.append((d.index, x.index, s.index, s.status, s.reason, *((signed(u.txg), signed(u.timestamp), signed(u.guid_sum), u.mmp_seq, signed(u.checkpoint_txg), u.endian) if u else (None,) * 6)))
    for a in pools:
        for top in a.pool.tops.values():
            for n, leaf in enumerate(top.leaves):
                leaves.append((signed(a.pool.guid), top.id, top.kind, n, signed(leaf.guid), leaf.path, leaf.member))
    trees = [(d.index, *(r[k] if k != "guid" or r[k] is None else signed(r[k]) for k in ("n", "parent", "depth", "kind", "id", "guid", "path", "ashift", "nparity"))) for d in devices if d.config and (t := nv.child(d.config, "vdev_tree")) for r in flatten_tree(t)]
    tables = {
        "labels": _frame(spark, labels, "member int, path string, base long, label int, offset long, config_checksum string, txg long, config string, reason string, slots int, verified int, empty int, corrupt int"),
        "uberblocks": _frame(spark, slots, "member int, label int, slot int, status string, reason string, txg long, ts long, guid_sum long, mmp_seq int, checkpoint_txg long, endian string"),
        "vdevs": _frame(spark, trees, "member int, n int, parent int, depth int, kind string, id long, guid long, path string, ashift long, nparity long"),
        "leaves": _frame(spark, leaves, "pool_guid long, top_id long, kind string, ord int, guid long, path string, member int"),
        "pools": _frame(spark, [(signed(a.pool.guid), a.pool.name, a.pool.txg, a.pool.children, a.readable(), a.missing_tops()) for a in pools], "guid long, name string, txg long, children int, readable boolean, missing array<int>"),
        "hosts": _frame(spark, [(signed(a.pool.guid), h["hostid"], h["hostname"], h["txg"]) for a in pools for h in a.hosts], "pool_guid long, hostid long, hostname string, txg long"),
        "stale": _frame(spark, [(signed(a.pool.guid), m) for a in pools for m in a.stale], "pool_guid long, member int"),
        "unaccounted": _frame(spark, [(signed(a.pool.guid), f["feature"], f["support"], f["why"]) for a in pools for f in a.unaccounted], "pool_guid long, feature string, support string, why string"),
    }
    return Scanned(devices, pools, tables)


def candidates(scanned: Scanned, pool: topology.Assembly) -> list[Uberblock]:
    """One verified root pointer per transaction group, newest first.

    The greatest (timestamp, sequence) of a group wins; full ties keep the
    first met, in order of members, labels and slots.
    """
    best: dict[int, Uberblock] = {}
    for d in scanned.devices:
        if d.config is None or nv.u64(d.config, "pool_guid") != pool.pool.guid:
            continue
        for label in d.labels:
            for s in label.slots:
                if s.status == "verified" and (s.ub.txg not in best or (s.ub.timestamp, s.ub.mmp_seq) > (best[s.ub.txg].timestamp, best[s.ub.txg].mmp_seq)):
                    best[s.ub.txg] = s.ub
    return [best[t] for t in sorted(best, reverse=True)]


# -- datasets

_DATASET = "txg long, ts long, seq int, guid long, name string, object long, kind string, snapshot boolean, clone boolean, creation_txg long, creation_time long, referenced long, unique_bytes long, origin_obj long, volsize long, volblocksize long, unknown array<string>, error string, properties string, status string"


def versions(spark: SparkSession, pool: topology.Assembly, roots: list[Uberblock], properties: bool = False) -> DataFrame:
    """Every dataset at every root pointer, one task a version.

    A version that can't be read is one row with status 'unreadable'; a part
    that can't is a row with status 'unread' and the part's name.
    """
    reader = Reader(pool.pool)

    def one(ub: Uberblock):
        empty = (None,) * 16
        try:
            meta = dsl.Meta(reader, ub.rootbp)
            tree = meta.walk(pool.pool.name)
        except (Damage, KeyError) as e:
            yield (ub.txg, ub.timestamp, 0, None, None, *empty[:12], str(e), None, "unreadable")
            return
        for i, d in enumerate(tree.datasets):
            props = None
            if properties:
                try:
                    props = json.dumps(meta.properties(d))
                except Damage as e:
                    props = json.dumps({"error": str(e)})
            yield (ub.txg, ub.timestamp, i, signed(d.guid), d.name, d.object, d.kind, d.snapshot, d.clone, d.creation_txg, d.creation_time, d.referenced, d.unique, d.origin_obj, d.volsize, d.volblocksize, d.unknown, d.error, props, "ok")
        for name, why in tree.unread:
            yield (ub.txg, ub.timestamp, len(tree.datasets), None, name, *empty[:12], why, None, "unread")

    return write_table(_tasks(spark, roots, one, _DATASET), "versions").df


def select_root(roots: list[Uberblock], txg: int | None = None, before: int | None = None) -> list[Uberblock]:
    """Root pointers to try, best first: that one, or the newest that fit."""
    if txg is not None:
        return [u for u in roots if u.txg == txg]
    return [u for u in roots if before is None or u.timestamp <= before]


def list_datasets(spark: SparkSession, scanned: Scanned, pool: topology.Assembly, txg: int | None = None, before: int | None = None, diff: bool = False, recursive: bool = False, properties: bool = False) -> DataFrame:
    """Datasets at one root pointer: a given one or nothing, else the newest that reads.

    With ``diff`` also what the newest version has (created) or lost
    (destroyed) against it, in column ``change``.
    """
    tried = versions(spark, pool, select_root(candidates(scanned, pool), txg, before), properties)
    at = tried.filter("status = 'ok'").agg(F.max("txg")).first()[0]
    rows = tried.filter((F.col("status") == "ok") & (F.col("txg") == F.lit(at)) & (~F.col("snapshot") | F.lit(recursive))).drop("status")
    if not diff:
        return rows.orderBy("seq")
    every = versions(spark, pool, candidates(scanned, pool), properties).filter("status = 'ok'")
    newest = every.agg(F.max("txg")).first()[0]
    now = every.filter((F.col("txg") == F.lit(newest)) & (~F.col("snapshot") | F.lit(recursive))).drop("status")
    created = now.join(rows.select("guid"), "guid", "left_anti").select(*rows.columns, F.lit("created").alias("change"))
    kept = rows.join(now.select("guid", F.lit(True).alias("_now")), "guid", "left").select(*rows.columns, F.when(F.col("_now").isNull(), "destroyed").alias("change"))
    return kept.unionByName(created).orderBy("txg", "seq")


def timeline(spark: SparkSession, scanned: Scanned, pool: topology.Assembly, from_txg: int | None = None, to_txg: int | None = None, about: str | None = None, with_pending: bool = False) -> DataFrame:
    """What happened between the surviving versions, in event order.

    ``about`` names a dataset (by a name it ever had, or its GUID); events of
    the pool stay. ``with_pending`` adds what each version was giving back.
    """
    roots = [u for u in candidates(scanned, pool) if (from_txg is None or u.txg >= from_txg) and (to_txg is None or u.txg <= to_txg)]
    # History that was rolled back: its timestamps lie before an earlier version's.
    top, dropped, line = None, [], []
    for u in reversed(roots):
        if top is not None and u.timestamp < top.timestamp:
            dropped.append((u.txg, "abandoned", history.KINDS.index("abandoned"), None, None, f"older than version {top.txg}", None, None))
            continue
        top = u
        line.append(u)
    every = versions(spark, pool, line)
    states = every.filter("status = 'ok'").drop("status", "ts", "seq", "properties", "error")
    read = every.filter("status = 'ok'").select("txg").distinct()
    unread = every.filter("status = 'unread'").select("txg", F.regexp_replace("name", "[/@]$", "").alias("prefix"))
    found = history.events(states, read, unread).select("txg", "kind", "kind_ord", "object", "guid", "details", "last_seen", "recover_with")
    for h in sorted(pool.hosts, key=lambda h: h["txg"])[:-1]:
        if (from_txg is None or h["txg"] >= from_txg) and (to_txg is None or h["txg"] <= to_txg):
            dropped.append((h["txg"], "host", history.KINDS.index("host"), None, None, f"last written by {h['hostname']} ({h['hostid']})", None, None))
    if with_pending:

        def one(ub):
            try:
                yield (ub.txg, "pending", history.KINDS.index("pending"), None, None, json.dumps(pending(pool, ub)), None, None)
            except (Damage, KeyError):
                return

        dropped += [tuple(r) for r in _tasks(spark, line, one, "txg long, kind string, kind_ord int, object string, guid long, details string, last_seen long, recover_with string").collect()]
    lost = every.filter("status = 'unreadable'").select("txg", F.lit("unreadable").alias("kind"), F.lit(history.KINDS.index("unreadable")).alias("kind_ord"), F.lit(None).cast("string").alias("object"), F.lit(None).cast("long").alias("guid"), F.col("error").alias("details"), F.lit(None).cast("long").alias("last_seen"), F.lit(None).cast("string").alias("recover_with"))
    out = found.unionByName(lost).unionByName(_frame(spark, dropped, "txg long, kind string, kind_ord int, object string, guid long, details string, last_seen long, recover_with string"))
    if about is not None:
        wanted = states.filter(F.col("name") == about).select("guid").distinct() if not about.isdigit() else _frame(spark, [(signed(int(about)),)], "guid long")
        hit = wanted.withColumn("_hit", F.lit(True))
        out = out.join(hit, "guid", "left").filter("_hit or kind in ('pending', 'unreadable', 'abandoned')").select(found.columns)
    from ..functions.bits import unsigned

    return out.orderBy("txg", "kind_ord", unsigned(F.col("guid")), "object")


def pending(pool: topology.Assembly, ub: Uberblock) -> dict[str, int | None]:
    """Space being given back at a version."""
    meta = dsl.Meta(Reader(pool.pool), ub.rootbp)
    return meta.pending(meta.walk(pool.pool.name).datasets)


# -- volumes


def _find(pool: topology.Assembly, roots: list[Uberblock], name: str, key: str | None = None) -> tuple[Uberblock, dsl.Dataset, Reader]:
    """A dataset at the newest version that has it and reads, and its reader, unlocked if a key is given."""
    reader, why = Reader(pool.pool), "no version"
    for ub in roots:
        try:
            meta = dsl.Meta(reader, ub.rootbp)
            tree = meta.walk(pool.pool.name)
        except (Damage, KeyError) as e:
            why = str(e)
            continue
        found = next((d for d in tree.datasets if d.name == name), None)
        if found is not None and found.kind not in ("unknown", "empty"):
            return ub, found, meta.unlock(found, key) if key else reader
        why = f"{name} is not there" if found is None else found.error or found.kind
    raise Damage(f"{name} can't be read: {why}")


def read_volume(spark: SparkSession, obj: Object, size: int, strict: bool = False, first: int = 0, last: int | None = None) -> DataFrame:
    """The volume's blocks that hold data: (blkid, off, state, data, reason).

    Holes are absent. A block that no copy verifies is 'salvaged' if the
    copies' readable parts together do, else 'zeroed' with its reason; with
    ``strict`` that fails the run.
    """
    step = obj.node.blocksize
    count = -(-size // step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for blkid in batch.column("id").slice(at, 64).to_pylist():
                    off = blkid * step
                    try:
                        if obj.locate(blkid) is None:
                            continue
                        rows.append((blkid, off, "read", obj.read(blkid)[: size - off], None))
                    except Damage as e:
                        try:
                            rows.append((blkid, off, "salvaged", obj.read(blkid, salvage=True)[: size - off], str(e)))
                        except Damage:
                            if strict:
                                raise e from None
                            rows.append((blkid, off, "zeroed", None, str(e)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()))], names=["blkid", "off", "state", "data", "reason"])

    last = count if last is None else last
    ids = spark.range(first, last, 1, max(1, min(last - first, spark.sparkContext.defaultParallelism * 4)))
    return ids.mapInArrow(run, "blkid long, off long, state string, data binary, reason string")


def image_digest(spark: SparkSession, path: str, names: tuple[str, ...] = ("sha256",)) -> dict[str, str]:
    """Digests of a whole image, in one ordered pass of one task."""

    def one(item):
        found = {n: hashlib.new(n) for n in names}
        with open(item, "rb") as f:
            while part := f.read(1 << 20):
                for h in found.values():
                    h.update(part)
        yield tuple(found[n].hexdigest() for n in names)

    return _tasks(spark, [path], one, ", ".join(f"{n} string" for n in names)).first().asDict()


def dump(spark: SparkSession, scanned: Scanned, pool: topology.Assembly, name: str, output: str, txg: int | None = None, strict: bool = False, hashes: tuple[str, ...] = ("sha256",), key: str | None = None) -> dict[str, Any]:
    """A volume as a sparse image; the report says what was read, left as holes and lost."""
    image.guard(output, pool.pool.paths)
    ub, ds, reader = _find(pool, select_root(candidates(scanned, pool), txg), name, key)
    obj, size = dsl.volume(reader, ds)
    image.create(output, size)
    done = write_table(image.write_blocks(read_volume(spark, obj, size, strict), output, ["blkid", "off", "state", "reason"]), "dump").df
    counts = {r["state"]: r["n"] for r in done.groupBy("state").agg(F.count("*").alias("n")).collect()}
    total = -(-size // obj.node.blocksize)
    bad = done.filter("state = 'zeroed'").orderBy("blkid").toLocalIterator()  # all of them, however many were lost
    zeroed = counts.get("zeroed", 0)
    report = {"dataset": name, "txg": ub.txg, "volsize": size, "blocksize": obj.node.blocksize, "blocks_total": total, "blocks_read": counts.get("read", 0), "blocks_salvaged": counts.get("salvaged", 0), "blocks_zeroed": zeroed, "blocks_holes": total - sum(counts.values()), "bad": [{"blkid": r["blkid"], "offset": r["off"], "len": min(obj.node.blocksize, size - r["off"]), "reason": r["reason"]} for r in bad]}
    return report | image_digest(spark, output, hashes) | {"status": EXIT["partial"] if zeroed else EXIT["ok"]}


def dump_resumable(spark: SparkSession, scanned: Scanned, pool: topology.Assembly, name: str, output: str, txg: int | None = None, stretch: int = 4096, stop_after: int | None = None) -> dict[str, Any]:
    """Like ``dump``, in stretches of blocks with a state file beside the image; a later call goes on.

    The state names the volume, its version and shape, how many blocks are
    done, what was lost and the digest of the image so far. It is replaced
    atomically after each stretch. A state of another volume, or an image that
    has changed, is refused. A call reads each byte of the image once to hash it.
    """
    image.guard(output, pool.pool.paths)
    ub, ds, reader = _find(pool, select_root(candidates(scanned, pool), txg), name)
    obj, size = dsl.volume(reader, ds)
    step = obj.node.blocksize
    identity = {"guid": str(ds.guid), "txg": ub.txg, "volsize": size, "blocksize": step}
    state_path = output + ".state.json"
    state: dict[str, Any] = {"identity": identity, "blocks_done": 0, "bad": [], "prefix_sha256": hashlib.sha256().hexdigest()}
    if os.path.exists(state_path):
        with open(state_path) as f:
            state = json.load(f)
        if state["identity"] != identity:
            raise ValueError("the state file is of another volume or version")
        sha = _prefix_digest(output, 0, min(size, state["blocks_done"] * step))
        if sha.hexdigest() != state["prefix_sha256"]:
            raise ValueError("the image has changed since the state was written")
    else:
        image.create(output, size)
        sha = hashlib.sha256()
    total, done = -(-size // step), 0
    while state["blocks_done"] < total and (stop_after is None or done < stop_after):
        first, last = state["blocks_done"], min(total, state["blocks_done"] + stretch)
        part = read_volume(spark, obj, size, first=first, last=last)
        bad = image.write_blocks(part, output, ["blkid", "off", "state", "reason"]).filter("state = 'zeroed'").orderBy("blkid").collect()
        state["bad"] += [{"blkid": r["blkid"], "offset": r["off"], "reason": r["reason"]} for r in bad]
        state["blocks_done"], done = last, done + 1
        state["prefix_sha256"] = _prefix_digest(output, first * step, min(size, last * step), sha).hexdigest()
        with open(state_path + ".new", "w") as f:
            json.dump(state, f)
        os.replace(state_path + ".new", state_path)
    finished = state["blocks_done"] == total
    status = EXIT["interrupted"] if not finished else EXIT["partial"] if state["bad"] else EXIT["ok"]
    return {"dataset": name, "output": output, "complete": finished, "sha256": state["prefix_sha256"] if finished else None, "status": status} | state


def _prefix_digest(path: str, first: int, last: int, sha=None):
    """``sha`` (a new one if none is given) carried on over the bytes from ``first`` to ``last``."""
    sha = hashlib.sha256() if sha is None else sha
    with open(path, "rb") as f:
        f.seek(first)
        while first < last and (part := f.read(min(last - first, 1 << 20))):
            sha.update(part)
            first += len(part)
    return sha


def image_names(datasets: list[tuple[str, int]]) -> list[str]:
    """File names for volumes: slashes become underscores, clashes get the GUID."""
    plain = [name.replace("/", "_").replace("@", "_") for name, _ in datasets]
    return [f"{p}-{guid:016x}.img" if plain.count(p) > 1 else f"{p}.img" for p, (_, guid) in zip(plain, datasets, strict=True)]


def dump_all(spark: SparkSession, scanned: Scanned, pool: topology.Assembly, prefix: str, folder: str, txg: int | None = None) -> dict[str, Any]:
    """Every volume at or below a name; a run that is repeated keeps what its manifest lists and the images still match."""
    rows = list_datasets(spark, scanned, pool, txg=txg).filter((F.col("kind") == "zvol") & hierarchy.in_scope(F.col("name"), prefix)).collect()
    os.makedirs(folder, exist_ok=True)
    manifest_path = os.path.join(folder, "manifest.json")
    earlier = {}
    if os.path.exists(manifest_path):
        with open(manifest_path) as f:
            earlier = {(v["dataset"], v["guid"], v["txg"]): v for v in json.load(f)["volumes"]}
    out = []
    for r, name in zip(rows, image_names([(r["name"], r["guid"] % (1 << 64)) for r in rows]), strict=True):
        path, key = os.path.join(folder, name), (r["name"], r["guid"], r["txg"])
        old = earlier.get(key)
        if old and os.path.exists(path) and _prefix_digest(path, 0, old["volsize"]).hexdigest() == old["sha256"]:
            out.append(old | {"kept": True})
            continue
        if os.path.exists(path):
            os.remove(path)
        out.append(dump(spark, scanned, pool, r["name"], path, txg=r["txg"]) | {"guid": r["guid"], "output": path, "kept": False})
        with open(manifest_path + ".new", "w") as f:
            json.dump({"pool": str(pool.pool.guid), "volumes": out + [v for k, v in earlier.items() if k[0] not in {o["dataset"] for o in out}]}, f)
        os.replace(manifest_path + ".new", manifest_path)
    return {"volumes": out, "status": exit_status([v["status"] for v in out])}


def exit_status(statuses: list[int]) -> int:
    """The run's status from its parts': a refusing medium, then an interruption, then the worst of the rest."""
    order = [EXIT[k] for k in ("medium", "interrupted", "refused", "unreadable", "unrecoverable", "partial", "usage", "ok")]
    return min(statuses, key=order.index, default=EXIT["ok"])


# -- carve


def surface_hits(raw: DataFrame, want: carve.Profile, strict: bool, codecs: tuple[str, ...], chunk: int) -> DataFrame:
    """Hits of every byte range, and rows (reason, rejected) that count what was turned down; batch or stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = ("member", "off", "slot", "found", "reason", "rejected", "type", "blocksize", "levels", "maxblkid", "size", "birth", "misses", "score", "dva")
        types = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.float64(), pa.string())
        for batch in batches:
            rows: list[tuple] = []
            for member, start, data in zip(batch.column("member").to_pylist(), batch.column("off").to_pylist(), batch.column("data").to_pylist(), strict=True):
                for base, buf, how in _surfaces(start, data, chunk, codecs):
                    rows += _slots(member, base, buf, how, chunk if how == "plain" else len(buf), want, strict)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=list(kinds))

    schema = "member int, off long, slot long, found string, reason string, rejected long, type int, blocksize long, levels int, maxblkid long, size long, birth long, misses array<string>, score double, dva string"
    return raw.mapInArrow(run, schema)


def carve_scan(spark: SparkSession, paths: list[str], profile: carve.Profile | None = None, strict: bool = False, codecs: tuple[str, ...] = (), chunk: int = block_source.CHUNK, groups: dict[int, int] | None = None, max_hits: int = 10_000) -> dict[str, DataFrame]:
    """Objects recognised on the raw surface, whatever points at them.

    Each slot belongs to the chunk in which it starts. Hits at one place of
    mirror siblings (``groups``: member -> group) count once. Gives candidates
    by rank, rejections by reason, and histograms.
    """
    block_source.register(spark)
    raw = spark.read.format("blockmember").option("paths", json.dumps(paths)).option("chunk", chunk).load()
    seen = write_table(surface_hits(raw, profile or carve.Profile(), strict, codecs, chunk), "carve").df
    hits = seen.filter("reason is null")
    group = F.create_map(*(x for k, v in (groups or {}).items() for x in (F.lit(k), F.lit(v)))) if groups else None
    key = F.coalesce(F.try_element_at(group, F.col("member")), -F.col("member") - 1) if group is not None else F.col("member")
    first = hits.groupBy(key.alias("group"), "off", "slot", "found").agg(F.min_by(F.struct(*hits.columns), "member").alias("h")).select("h.*")
    ranked = first.withColumn("rank", classify.rank_band(F.col("score"), F.size("misses") == 0)).withColumn("type_name", F.element_at(F.create_map(*(x for k in range(54) for x in (F.lit(k), F.lit(object_type(k))))), F.col("type"))).drop("reason", "rejected")
    candidates_ = classify.ranked_ids(ranked, [F.desc("rank"), F.col("member"), F.col("off"), F.col("slot")], max_hits)
    counted = seen.filter("reason is not null").groupBy("reason").agg(F.sum("rejected").alias("n"))
    missed = first.select(F.explode("misses").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    rejections = counted.unionByName(missed).groupBy("reason").agg(F.sum("n").alias("n")).withColumn("profile", F.col("reason").startswith("profile_")).orderBy(F.desc("n"), "reason")
    bars = first.select(F.explode(F.array(F.struct(F.lit("type").alias("what"), F.col("type").cast("long").alias("value")), F.struct(F.lit("blocksize").alias("what"), F.col("blocksize").alias("value")), F.struct(F.lit("levels").alias("what"), F.col("levels").cast("long").alias("value")), F.struct(F.lit("txg").alias("what"), (F.floor(F.col("birth") / 1000) * 1000).cast("long").alias("value")))).alias("b"))
    histograms = bars.groupBy("b.what", "b.value").agg(F.count("*").alias("n")).orderBy("what", F.desc("n"), "value")
    return {"candidates": candidates_, "rejections": rejections, "histograms": histograms}


def _surfaces(start: int, data: bytes, chunk: int, codecs: tuple[str, ...]):
    """The chunk itself, then every block that a codec can unpack at a sector of it."""
    yield start, data, "plain"
    for codec in codecs:
        code = compress.CODES["gzip-6" if codec == "gzip" else codec]
        for at in range(0, min(chunk, len(data)), carve.SLOT):
            piece = data[at : at + (16 << 10)]
            if compress.could_start(codec, piece, 16 << 10):
                try:
                    yield start + at, compress.decompress(code, piece, 16 << 10), codec
                except Damage:
                    continue


def _slots(member: int, base: int, buf: bytes, how: str, own: int, want: carve.Profile, strict: bool) -> list[tuple]:
    """Hits in a buffer, and one row per reason with how many slots it rejected."""
    whole = len(buf) // carve.SLOT * carve.SLOT
    heads = carve.head_reasons(np.frombuffer(buf[:whole], np.uint8))[: -(-min(own, whole) // carve.SLOT)]
    counts = {carve.STRUCTURAL[k]: int(n) for k, n in enumerate(np.bincount(heads[heads >= 0], minlength=5)) if n}
    out = []
    for i in np.flatnonzero(heads < 0).tolist():
        at = i * carve.SLOT
        d, reason = carve.judge(buf[at : at + 16 * carve.SLOT])
        if d is None:
            counts[reason] = counts.get(reason, 0) + 1
            continue
        missed = want.misses(d)
        if missed and strict:
            for m in missed[:1]:
                counts[m] = counts.get(m, 0) + 1
            continue
        live = next((p for p in d.blkptr if not p.hole and not p.embedded), None)
        first = f"{live.dva[0].vdev}:{live.dva[0].offset}" if live else None
        off, slot = (base + at, 0) if how == "plain" else (base, i)
        out.append((member, off, slot, how, None, None, d.type, d.blocksize, d.nlevels, signed(d.maxblkid), signed(d.size), signed(carve.birth(d)), missed, carve.score(d), first))
    return out + [(member, base, -1, how, r, n, None, None, None, None, None, None, [], None, None) for r, n in counts.items()]


def owners(found: DataFrame, datasets: DataFrame) -> DataFrame:
    """Carved candidates with the dataset whose first live pointer is theirs; the newest creation wins."""
    best = datasets.groupBy("dva").agg(F.max_by("guid", F.struct("creation_txg", -F.col("seq"))).alias("dataset_guid"))
    return found.join(best, "dva", "left")


def assess(reader: Reader, obj: Object, sample: int = 256) -> dict[str, Any]:
    """What an evenly strided walk of an object's blocks finds."""
    total = obj.node.maxblkid + 1
    step = 1 if not sample or total <= sample else -(-total // sample)
    out: dict[str, Any] = {"blocks_total": total, "sampled": step > 1, "verified": 0, "holes": 0, "failed": 0, "birth_min": None, "birth_max": None}
    for blkid in range(0, total, step):
        try:
            bp = obj.locate(blkid)
            if bp is None:
                out["holes"] += 1
                continue
            out["birth_min"] = bp.birth if out["birth_min"] is None else min(out["birth_min"], bp.birth)
            out["birth_max"] = bp.birth if out["birth_max"] is None else max(out["birth_max"], bp.birth)
            obj.read(blkid)
            out["verified"] += 1
        except Damage:
            out["failed"] += 1
    looked = out["verified"] + out["holes"] + out["failed"]
    return out | {"agreement": (out["verified"] + out["holes"]) / looked if looked else 0.0}


def _surface(spark: SparkSession, paths: list[str], fn, schema: str, chunk: int = block_source.CHUNK) -> DataFrame:
    """``fn(member, start, data, chunk)`` gives rows of every byte range of the members."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = _parse_datatype_string(schema)
    arrow = to_arrow_schema(target)
    block_source.register(spark)
    raw = spark.read.format("blockmember").option("paths", json.dumps(paths)).option("chunk", chunk).load()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for m, a, d in zip(batch.column("member").to_pylist(), batch.column("off").to_pylist(), batch.column("data").to_pylist(), strict=True) for r in fn(m, a, d, chunk)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return raw.mapInArrow(run, target)


def zero_points(spark: SparkSession, paths: list[str], psize: int | None = None, least: int = 1) -> DataFrame:
    """Where members begin, by the root pointers whose seals hold there: most confirmations first."""

    def one(member, start, data, chunk):
        for a in anchors.anchors(data, start, chunk, psize):
            yield (member, a.base, a.label, a.slot, a.shift, signed(a.txg))

    found = _surface(spark, paths, one, "member int, base long, label int, slot int, shift int, txg long")
    grouped = found.groupBy("member", "base").agg(F.count("*").alias("anchors"), F.min("txg").alias("min_txg"), F.max("txg").alias("max_txg"), F.array_sort(F.collect_set("label")).alias("labels"))
    return grouped.filter(F.col("anchors") >= least).orderBy(F.desc("anchors"), "member", "base")


def base_by_pointers(spark: SparkSession, path: str, bases: list[int], codecs: tuple[str, ...] = ("lz4",), most: int = 64) -> DataFrame:
    """Candidate starts of a member by how many carved pointers hold there, and whether one is clear.

    The probes nearest the front come first; a start is clear with eight
    confirmations or more, and twice the next one's.
    """

    def one(member, start, data, chunk):
        for base, buf, _ in _surfaces(start, data, chunk, codecs):
            for i in np.flatnonzero(carve.head_reasons(np.frombuffer(buf[: len(buf) // 512 * 512], np.uint8)) < 0).tolist():
                d, _ = carve.judge(buf[512 * i : 512 * (i + 16)])
                for bp in d.blkptr if d else ():
                    if anchors.usable_probe(bp):
                        yield (bp.live[0].offset, bp.raw)

    probes = _surface(spark, [path], one, "offset long, raw binary").dropDuplicates(["raw"]).orderBy("offset", "raw").limit(most).collect()

    def confirm(base):
        member = Member(path)
        try:
            good = 0
            for p in probes:
                bp = blkptr(p["raw"])
                try:
                    data = member.read(base + DATA_AT + p["offset"], bp.psize)
                except OSError:
                    continue
                good += verdict(bp.checksum, data, bp.cksum) == OK
            yield (base, good, len(probes))
        finally:
            member.close()

    counts = write_table(_tasks(spark, bases, confirm, "base long, confirmed long, probes long"), "bases").df
    clear = classify.margin_winner(counts.withColumn("_all", F.lit(1)), ["_all"], "confirmed", "base").select("base", "clear")
    return counts.join(clear, "base", "left").withColumn("clear", F.coalesce("clear", F.lit(False))).orderBy(F.desc("confirmed"), "base")


def carve_roots(spark: SparkSession, pool: topology.Assembly, codecs: tuple[str, ...] = ("lz4",), max_roots: int = 64) -> DataFrame:
    """Meta object sets on the surface that no label leads to, by how much of a pool each shows."""
    reader = Reader(pool.pool)

    def one(member, start, data, chunk):
        seen = set()
        for at in range(0, min(chunk, len(data)), carve.SLOT):
            piece = data[at : at + 4096]
            forms = [("plain", piece)] if piece[0] == 10 else []
            for codec in codecs:
                if compress.could_start(codec, piece, 4096):
                    try:
                        forms.append((codec, compress.decompress(compress.CODES["gzip-6" if codec == "gzip" else codec], piece, 4096)))
                    except Damage:
                        pass
            for how, raw in forms:
                if len(raw) < 1024 or raw in seen:
                    continue
                try:
                    found = objset(raw)
                    if found.type != 1 or carve.judge(raw[:512].ljust(8192, b"\0"))[0] is None:
                        continue
                    seen.add(raw)
                    tree = dsl.Meta(reader, raw).walk(pool.pool.name)
                    yield (member, start + at, how, signed(carve.birth(found.meta)), len(tree.datasets), [d.name for d in tree.datasets], raw)
                except (Damage, KeyError, IndexError):
                    continue

    found = write_table(_surface(spark, pool.pool.paths, one, "member int, off long, found string, birth long, datasets int, names array<string>, raw binary"), "roots").df
    once = found.groupBy("raw").agg(F.min_by(F.struct("member", "off", "found", "birth", "datasets", "names"), F.struct("member", "off")).alias("r")).select("r.*", "raw")
    return once.orderBy(F.desc("datasets"), F.desc("birth"), "member", "off").limit(max_roots)


# -- files


def list_files(scanned: Scanned, pool: topology.Assembly, spark: SparkSession, name: str, path: str = "", recursive: bool = True, txg: int | None = None, key: str | None = None) -> DataFrame:
    """Entries of a file system, depth first; names are bytes, with a text form to show."""

    def one(roots):
        _, ds, reader = _find(pool, roots, name, key)
        fs = Filesystem(reader, ds)
        start = fs.lookup(path.encode("utf-8", "surrogateescape")) if path else None
        for i, e in enumerate(fs.walk(start, path.encode("utf-8", "surrogateescape"), recursive)):
            z = e.znode
            yield (i, e.path.decode("utf-8", "replace"), e.path.hex(), e.object, e.kind, *((z.mode, z.size, z.uid, z.gid, z.links, z.times.get("mtime", (None,))[0]) if z else (None,) * 6), e.error)

    rows = _tasks(spark, [select_root(candidates(scanned, pool), txg)], one, "seq int, path string, path_hex string, object long, kind string, mode long, size long, uid long, gid long, links long, mtime long, error string")
    shown = write_table(rows, "files").df
    parent = F.regexp_replace("path_hex", "2f[0-9a-f]*$", "")
    twice = F.count("*").over(Window.partitionBy(parent, "path_hex")) > 1
    content = F.first_value("path").over(Window.partitionBy("object").orderBy("seq"))
    return shown.withColumn("second_name", twice).withColumn("hardlink_to", F.when((F.col("kind") == "file") & (content != F.col("path")), content)).orderBy("seq")


def extract_files(scanned: Scanned, pool: topology.Assembly, spark: SparkSession, name: str, output: str, txg: int | None = None, key: str | None = None) -> DataFrame:
    """A file system's tree under a new folder, and its manifest; contents are written by many tasks."""
    image.guard(output, pool.pool.paths)
    entries = list_files(scanned, pool, spark, name, txg=txg, key=key).collect()
    os.makedirs(output)
    for e in entries:  # folders first, in walk order
        if e["kind"] == "dir" and e["path"]:
            os.mkdir(_inside(output, bytes.fromhex(e["path_hex"])))
    wanted = [(e["seq"], e["path_hex"], e["object"], e["size"]) for e in entries if e["kind"] in ("file", "symlink") and e["hardlink_to"] is None]
    roots = select_root(candidates(scanned, pool), txg)
    step = max(1, -(-len(wanted) // (spark.sparkContext.defaultParallelism * 2)))

    def some(item):
        _, ds, reader = _find(pool, roots, name, key)
        fs = Filesystem(reader, ds)
        for seq, path_hex, number, size in item:
            target, sha, error = _inside(output, bytes.fromhex(path_hex)), hashlib.sha256(), None
            try:
                z = fs.znode(fs.objects.get(number))
                if z.mode >> 12 == 10:
                    os.symlink(fs.symlink(number, z), target)
                    yield (seq, None, None)
                    continue
                with open(target, "wb") as f:
                    for part in fs.contents(number, size):
                        sha.update(part)
                        f.write(part)
                os.utime(target, ns=(z.times["atime"][0] * 10**9, z.times["mtime"][0] * 10**9))
            except FileExistsError:
                pass
            except (Damage, OSError) as e:
                error = str(e)
            yield (seq, sha.hexdigest() if error is None else None, error)

    done = _tasks(spark, [wanted[i : i + step] for i in range(0, len(wanted), step)], some, "seq int, sha256 string, write_error string")
    manifest = list_files(scanned, pool, spark, name, txg=txg, key=key).join(write_table(done, "extract").df, "seq", "left")
    for e in entries:
        if e["hardlink_to"] is not None:
            os.link(os.path.join(output, e["hardlink_to"]), _inside(output, bytes.fromhex(e["path_hex"])))
    return manifest.orderBy("seq")


def _inside(folder: str, path: bytes) -> bytes:
    from ..pool.files import is_component

    parts = path.split(b"/")
    if not all(map(is_component, parts)):
        raise ValueError(f"{path!r} is no path below the output")
    at = folder.encode()
    for p in parts[:-1]:
        at = os.path.join(at, p)
        if os.path.islink(at):
            raise ValueError(f"{at!r} is a link")
    return os.path.join(at, parts[-1])


def list_objects(scanned: Scanned, pool: topology.Assembly, spark: SparkSession, name: str, txg: int | None = None) -> DataFrame:
    """Every object of a dataset with the digest of its contents; one task finds the numbers, all of them read the contents."""
    roots = select_root(candidates(scanned, pool), txg)

    def numbers(roots):
        _, ds, reader = _find(pool, roots, name)
        for number, _ in Objects(reader, ds.bp).numbers():
            yield (number,)

    found = write_table(_tasks(spark, [roots], numbers, "object long"), "objects")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        objects = None
        for batch in batches:
            if objects is None:
                _, ds, reader = _find(pool, roots, name)
                objects = Objects(reader, ds.bp)
            rows = []
            for number in batch.column("object").to_pylist():
                try:
                    node = objects.get(number)
                except Damage:
                    rows.append((number, None, None, None, None, None, 1))
                    continue
                obj, sha, errors = Object(reader, node), hashlib.sha256(), 0
                for blkid in range(node.maxblkid + 1):
                    try:
                        sha.update(obj.read(blkid))
                    except Damage:
                        errors += 1
                rows.append((number, object_type(node.type), node.type, node.blocksize, signed(node.maxblkid), sha.hexdigest() if not errors else None, errors))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["object", "kind", "type_code", "blocksize", "maxblkid", "sha256", "errors"])

    dealt = found.df.repartition(spark.sparkContext.defaultParallelism * 2, "object")
    return dealt.mapInArrow(run, "object long, kind string, type_code int, blocksize long, maxblkid long, sha256 string, errors long").orderBy("object")


# -- report


def report_build(spark: SparkSession, logs: list[str]) -> dict[str, DataFrame]:
    """The consolidated sections of evidence logs."""
    records, rejected = evidence.read_logs(spark, logs)
    once = write_table(custody.once_across_logs(records, "log", ["text"]), "records").df
    seq = F.col("ts") * 1_000_000 + F.col("log") * 10_000 + F.col("line")
    commands = once.withColumn("seq", seq).select("seq", "ts", "log", "line", "tool", "version", "host", "status", F.concat_ws(" ", "argv").alias("command"))
    inputs = once.select(seq.alias("seq"), "tool", F.explode("inputs").alias("f")).select("seq", "tool", "f.*")
    outputs = once.select(seq.alias("seq"), "tool", F.explode("outputs").alias("f")).select("seq", "tool", "f.*")
    tools = once.groupBy("tool").agg(F.array_sort(F.collect_set("version")).alias("versions"), F.min(seq).alias("first"))
    last = outputs.groupBy("path").agg(F.max_by(F.struct(*[c for c in outputs.columns if c != "path"]), "seq").alias("o")).select("path", "o.*")
    kept = custody.first_kept(inputs, ["path"], "sha256", "seq")
    by = inputs.groupBy("path").agg(F.max_by("size", "seq").alias("size"), F.max_by("kind", "seq").alias("kind"), F.array_sort(F.collect_set("tool")).alias("tools"))
    evidence_ = by.join(kept, "path")
    result = F.col("result")
    extracted = once.filter(F.get_json_object(result, "$.dataset").isNotNull()).select(seq.alias("seq"), F.get_json_object(result, "$.dataset").alias("dataset"), F.get_json_object(result, "$.txg").cast("long").alias("txg"), F.get_json_object(result, "$.sha256").alias("sha256"), F.get_json_object(result, "$.blocks_zeroed").cast("long").alias("blocks_zeroed"), F.col("outputs")[0]["path"].alias("output"), (F.col("status") == EXIT["ok"]).alias("complete"))
    finished = custody.finished_later(extracted, ["dataset", "txg", "output"], "seq", F.col("complete")).select("seq", F.lit(True).alias("finished_later"))
    extractions = extracted.join(finished, "seq", "left").withColumn("finished_later", F.coalesce("finished_later", F.lit(False)))
    warnings = evidence_.filter("conflict").select(F.concat(F.lit("input hash changed: "), "path").alias("warning")).unionByName(tools.filter("size(versions) > 1").select(F.concat(F.lit("several versions of "), "tool").alias("warning"))).unionByName(rejected.select(F.format_string("log %d line %d is no record", F.col("log"), F.col("line")).alias("warning"))).distinct().orderBy("warning")
    return {"commands": commands.orderBy("seq"), "evidence": evidence_.orderBy("path"), "outputs": last.orderBy("path"), "tools": tools.orderBy("first"), "extractions": extractions.orderBy("seq"), "warnings": warnings}


def report_verify(spark: SparkSession, sections: dict[str, DataFrame], root: str | None = None) -> DataFrame:
    """Every recorded file against the file on disk now: PASS, FAIL, MISSING or UNHASHED.

    ``root`` is where the files lie now; they are found there by their names.
    """
    both = sections["evidence"].select(F.lit("input").alias("section"), "path", "sha256").unionByName(sections["outputs"].select(F.lit("output").alias("section"), "path", "sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column("path").to_pylist():
                at = os.path.join(root, os.path.basename(path)) if root else path
                out.append(evidence.describe(at).get("sha256") if os.path.exists(at) else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("section", "path", "sha256")), pa.array(out, pa.string())], names=["section", "path", "recorded", "computed"])

    found = both.mapInArrow(run, "section string, path string, recorded string, computed string")
    return found.withColumn("status", integrity.verdict(F.col("recorded"), F.col("computed"))).orderBy("section", "path")


def report_differences(left: dict[str, DataFrame], right: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What two builds of a report have differently, section by section."""
    return {name: integrity.both_ways(left[name], right[name]) for name in left}


def markdown(sections: dict[str, DataFrame]) -> str:
    """The sections as Markdown tables; nothing from the evidence can act as markup or steer a terminal."""

    def safe(v: Any) -> str:
        text = "" if v is None else str(v)
        text = "".join(c if c.isprintable() else f"\\u{ord(c):04x}" for c in text)
        return "".join("\\" + c if c in "\\`*_{}[]<>()#+-.!|~" else c for c in text)

    out = []
    for name, df in sections.items():
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        out += ["| " + " | ".join(safe(v) for v in row) + " |" for row in df.collect()] + [""]
    return "\n".join(out)
