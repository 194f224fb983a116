import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lodewell.decode import Damage, blocks, carve, checksums, crypt
from lodewell.decode import dsl as dsl_decode
from lodewell.decode.blocks import Dva
from lodewell.fixtures.builder import Builder, Files, Item, Key, Volume
from lodewell.operators import history
from lodewell.plans import commands
from lodewell.functions import display
from lodewell.pool import assemble, datasets, layout, medium, reader
from lodewell.pool.files import Filesystem
from lodewell.pool.members import Member, Refused
from lodewell.sources import blocks as block_source
from lodewell.sources import evidence, image

SIZE = 8 << 20
ROOT = Item(1, None, 5)


def volume(seed=1, compression="lz4", checksum="sha256", blocks=40):
    rnd = random.Random(seed)
    return Volume(blocks * 8192, 8192, {i: (bytes([i]) * 3000 + rnd.randbytes(900)).ljust(8192, b"\0") for i in range(0, blocks, 3)}, compression, checksum)


def image_of(vol):
    return b"".join(vol.blocks.get(i, bytes(vol.blocksize)) for i in range(vol.size // vol.blocksize))


def scanned(spark, paths, **options):
    found = commands.scan(spark, paths, **options)
    return found, assemble.choose(found.pools)


@pytest.fixture(scope="module")
def history_pool(spark, tmp_path_factory):
    """A volume that is created, snapshotted, renamed, resized and destroyed over five versions."""
    folder = tmp_path_factory.mktemp("history")
    b = Builder(str(folder), "mirror", 2, size=SIZE)
    vol, fs = volume(), Files({"a/b.txt": b"hello", "a/c/d": random.Random(2).randbytes(9000), "z": b""}, {"ln": "a/b.txt"})
    files = Item(3, fs, 12)
    b.commit(100, 1000, {"": ROOT, "fs": files})
    b.commit(101, 1010, {"": ROOT, "fs": files, "vol": Item(2, vol, 101, props={"compression": 15, "comment": "text"})})
    b.commit(102, 1020, {"": ROOT, "fs": files, "vol": Item(2, vol, 101, {"s": (77, 102)})})
    small = Volume(vol.size // 2, vol.blocksize, {k: v for k, v in vol.blocks.items() if k < 20}, "lz4")
    b.commit(103, 1030, {"": ROOT, "fs": files, "new": Item(2, small, 101, {"s": (77, 102)})})
    b.commit(104, 1040, {"": ROOT, "fs": files})
    return b.finish(), vol, small, fs


def test_scan_tables(spark, history_pool):
    paths, *_ = history_pool
    found, pool = scanned(spark, paths)
    t = found.tables
    assert t["labels"].filter("config_checksum = 'Ok' and corrupt = 0 and verified = 5").count() == 8
    assert {r.txg for r in t["uberblocks"].collect()} == {100, 101, 102, 103, 104}
    assert [(r.name, r.txg, r.readable, r.missing) for r in t["pools"].collect()] == [("tank", 104, True, [])]
    assert [(r.kind, r.ord, r.member) for r in t["leaves"].orderBy("ord").collect()] == [("mirror", 0, 0), ("mirror", 1, 1)]
    assert t["unaccounted"].count() == 0 and [(r.hostid, r.hostname) for r in t["hosts"].collect()] == [(0x1234, "here")]
    assert [u.txg for u in commands.candidates(found, pool)] == [104, 103, 102, 101, 100]


def test_list_at_versions(spark, history_pool):
    paths, *_ = history_pool
    found, pool = scanned(spark, paths)

    def names(**options):
        return [r.name for r in commands.list_datasets(spark, found, pool, **options).collect()]

    assert names() == ["tank", "tank/fs"]
    assert names(txg=102) == ["tank", "tank/fs", "tank/vol"] and names(txg=102, recursive=True)[-1] == "tank/vol@s"
    assert names(before=1015) == ["tank", "tank/fs", "tank/vol"] and names(txg=99) == [] and names(before=5) == []
    changes = {r.name: r.change for r in commands.list_datasets(spark, found, pool, txg=101, diff=True).collect()}
    assert changes["tank/vol"] == "destroyed" and changes["tank/fs"] is None
    props = json.loads(commands.list_datasets(spark, found, pool, txg=101, properties=True).filter("name = 'tank/vol'").first().properties)
    assert {p["name"]: p["meaning"] or p["text"] for p in props} == {"compression": "lz4", "comment": "text"}
    row = commands.list_datasets(spark, found, pool, txg=103).filter("kind = 'zvol'").first()
    assert (row.name, row.volsize, row.volblocksize, row.creation_txg) == ("tank/new", 20 * 8192, 8192, 101)


def test_timeline(spark, history_pool):
    paths, vol, small, _ = history_pool
    found, pool = scanned(spark, paths)
    got = [(r.txg, r.kind, r.object, r.details, r.last_seen) for r in commands.timeline(spark, found, pool).collect()]
    assert got == [
        (101, "created", "tank/vol", None, None),
        (102, "snapshot", "tank/vol@s", None, None),
        (103, "renamed", "tank/new", "was tank/vol", None),
        (103, "renamed", "tank/new@s", "was tank/vol@s", None),
        (103, "property", "tank/new", f"volsize: {vol.size} -> {small.size}", None),
        (103, "property", "tank/new@s", f"volsize: {vol.size} -> {small.size}", None),
        (104, "destroyed", "tank/new", None, 103),
        (104, "snapshot-destroyed", "tank/new@s", None, 103),
    ]
    about = commands.timeline(spark, found, pool, about="tank/vol@s").collect()
    assert {r.guid for r in about} == {77} and [r.txg for r in about] == [102, 103, 103, 104]
    assert [r.txg for r in commands.timeline(spark, found, pool, from_txg=103, to_txg=104).collect()] == [104, 104]


def test_dump_and_digest(spark, history_pool, tmp_path):
    paths, vol, _, _ = history_pool
    found, pool = scanned(spark, paths)
    out = str(tmp_path / "vol.img")
    report = commands.dump(spark, found, pool, "tank/vol", out, hashes=("sha256", "md5"))
    want = image_of(vol)
    assert open(out, "rb").read() == want
    assert (report["txg"], report["sha256"], report["md5"]) == (102, hashlib.sha256(want).hexdigest(), hashlib.md5(want).hexdigest())
    assert (report["blocks_total"], report["blocks_read"], report["blocks_holes"], report["blocks_zeroed"], report["status"]) == (40, 14, 26, 0, 0)
    with pytest.raises(Damage):
        commands.dump(spark, found, pool, "tank/none", str(tmp_path / "x"))
    with pytest.raises(image.Overlap):
        commands.dump(spark, found, pool, "tank/vol", paths[0])
    link = str(tmp_path / "link")
    os.symlink(paths[1], link)
    with pytest.raises(image.Overlap):
        commands.dump(spark, found, pool, "tank/vol", link)


@pytest.mark.parametrize(("kind", "disks", "parity", "lose"), [("mirror", 3, 0, 2), ("raidz", 4, 2, 2), ("raidz", 3, 1, 1), ("raidz", 5, 3, 3), ("draid", 6, 2, 2), ("draid", 4, 1, 1), ("single", 1, 0, 0)])
def test_lost_members(tmp_path, kind, disks, parity, lose):
    for compression, checksum in (("off", "fletcher4"), ("gzip-6", "fletcher2"), ("zstd", "sha256"), ("lzjb", "sha512"), ("zle", "fletcher4")):
        b = Builder(str(tmp_path), kind, disks, parity, size=SIZE)
        vol = volume(3, compression, checksum)
        b.commit(7, 10, {"": ROOT, "vol": Item(2, vol, 6)})
        paths = b.finish()
        devices = [assemble.scan(p, i) for i, p in enumerate(paths)]
        kept = devices[lose:]
        pool = assemble.choose(assemble.assemble(kept)).pool
        pool.paths = paths
        root = next(s.ub for s in kept[0].labels[0].slots if s.status == "verified").rootbp
        r = reader.Reader(pool)
        ds = next(d for d in datasets.Meta(r, root).walk("tank").datasets if d.name == "tank/vol")
        obj, size = datasets.volume(r, ds)
        assert b"".join(obj.read(i) for i in range(size // 8192)) == image_of(vol)
        if lose:
            assert not assemble.choose(assemble.assemble(devices[lose + 1 :])).readable() if devices[lose + 1 :] else True


def test_silent_damage_is_rebuilt(tmp_path):
    """A data column that reads but is wrong: parity stands in for whichever column it is."""
    b = Builder(str(tmp_path), "raidz", 4, 1, size=SIZE)
    vol = volume(4, "off", "sha256")
    b.commit(7, 10, {"": ROOT, "vol": Item(2, vol, 6)})
    image_ = bytearray(b.images[2])
    image_[4 << 20 : (4 << 20) + (1 << 20)] = random.Random(1).randbytes(1 << 20)
    b.images[2] = image_
    paths = b.finish()
    devices = [assemble.scan(p, i) for i, p in enumerate(paths)]
    r = reader.Reader(assemble.choose(assemble.assemble(devices)).pool)
    root = next(s.ub for s in devices[0].labels[0].slots if s.status == "verified").rootbp
    ds = next(d for d in datasets.Meta(r, root).walk("tank").datasets if d.name == "tank/vol")
    obj, size = datasets.volume(r, ds)
    assert b"".join(obj.read(i) for i in range(size // 8192)) == image_of(vol)


@pytest.mark.parametrize(("kind", "disks", "parity"), [("raidz", 8, 2), ("raidz", 12, 3), ("draid", 6, 2)])
def test_healthy_blocks_are_put_together_once(tmp_path, monkeypatch, kind, disks, parity):
    """No parity is read or solved for a block whose columns verify; with a bad column the tries end with the budget."""
    b = Builder(str(tmp_path), kind, disks, parity, size=SIZE)
    vol = volume(4, "off", "sha256")
    b.commit(7, 10, {"": ROOT, "vol": Item(2, vol, 6)})
    paths = b.finish()
    devices = [assemble.scan(p, i) for i, p in enumerate(paths)]
    r = reader.Reader(assemble.choose(assemble.assemble(devices)).pool)
    root = next(s.ub for s in devices[0].labels[0].slots if s.status == "verified").rootbp
    solved, reads = [], []
    solve, leaf = reader.raidz.reconstruct, reader.Reader._leaf
    monkeypatch.setattr(reader.raidz, "reconstruct", lambda *a: solved.append(1) or solve(*a))
    monkeypatch.setattr(reader.Reader, "_leaf", lambda *a: reads.append(a[2]) or leaf(*a))
    ds = next(d for d in datasets.Meta(r, root).walk("tank").datasets if d.name == "tank/vol")
    obj, size = datasets.volume(r, ds)
    bp = obj.locate(0)
    reads.clear()
    assert obj.read(0) == image_of(vol)[:8192] and not solved
    columns = [c for row in r.pool.tops[bp.dva[0].vdev].rows(bp.dva[0].offset, bp.psize) for c in row[parity:] if c.size]
    assert len(reads) == len(columns) * len([d for d in bp.dva if not d.empty][:1])
    monkeypatch.setattr(reader, "verdict", lambda *a, **k: reader.MISMATCH)
    monkeypatch.setattr(reader.Budget, "__init__", lambda self: setattr(self, "left", 5))
    with pytest.raises(reader.Unreadable):
        r.raw(bp, [])
    assert len(solved) <= 5


def test_unreadable_blocks_are_zeroed_or_strict(spark, tmp_path):
    b = Builder(str(tmp_path), "single", 1, size=SIZE)
    vol = volume(5, "off", "fletcher4")
    b.commit(7, 10, {"": ROOT, "vol": Item(2, vol, 6)})
    at = b.images[0].find(vol.blocks[9][:3900])
    b.images[0][at] ^= 255
    found, pool = scanned(spark, b.finish())
    report = commands.dump(spark, found, pool, "tank/vol", str(tmp_path / "v"))
    assert (report["blocks_zeroed"], report["status"]) == (1, 4) and [x["blkid"] for x in report["bad"]] == [9]
    want = bytearray(image_of(vol))
    want[9 * 8192 : 10 * 8192] = bytes(8192)
    assert open(tmp_path / "v", "rb").read() == bytes(want)
    with pytest.raises(Exception, match="no copy verifies"):
        commands.dump(spark, found, pool, "tank/vol", str(tmp_path / "w"), strict=True)


def test_files(spark, history_pool, tmp_path):
    paths, _, _, fs = history_pool
    found, pool = scanned(spark, paths)
    rows = commands.list_files(found, pool, spark, "tank/fs").collect()
    assert [(r.path, r.kind) for r in rows] == [("", "dir"), ("a", "dir"), ("a/b.txt", "file"), ("a/c", "dir"), ("a/c/d", "file"), ("ln", "symlink"), ("z", "file")]
    assert [r.size for r in rows if r.kind == "file"] == [5, 9000, 0]
    assert [r.path for r in commands.list_files(found, pool, spark, "tank/fs", "A/C").collect()] == ["A/C", "A/C/d"]
    out = tmp_path / "tree"
    manifest = {r.path: r.sha256 for r in commands.extract_files(found, pool, spark, "tank/fs", str(out)).collect()}
    for path, data in fs.files.items():
        assert (out / path).read_bytes() == data and manifest[path] == hashlib.sha256(data).hexdigest()
    assert os.readlink(out / "ln") == "a/b.txt"
    objects = commands.list_objects(found, pool, spark, "tank/fs").collect()
    assert {r.kind for r in objects} >= {"master node", "directory", "plain file"} and all(r.errors == 0 for r in objects)


def test_carve(spark, history_pool):
    """The volume that no root of the newest version leads to is found on the surface."""
    paths, vol, *_ = history_pool
    got = commands.carve_scan(spark, paths, carve.Profile(type=23, volblocksize=8192), codecs=("lz4",), chunk=1 << 20, groups={0: 0, 1: 0})
    best = got["candidates"].filter("size(misses) = 0").collect()
    assert best and best[0].id == "c0001" and all(r.type_name == "zvol" and r["rank"] >= 0.55 for r in best)
    assert {(r.member, r.blocksize) for r in best} == {(0, 8192)}
    others = got["candidates"].filter("size(misses) > 0").agg(F.max("rank")).first()[0]
    assert others <= 0.45
    counts = {r.reason: r.n for r in got["rejections"].collect()}
    assert counts["free"] > 1000 and counts["profile_type"] > 0
    assert {r.what for r in got["histograms"].collect()} == {"type", "blocksize", "levels", "txg"}
    strict = commands.carve_scan(spark, paths[:1], carve.Profile(type=23), strict=True, codecs=("lz4",))
    assert strict["candidates"].filter("type <> 23").count() == 0


def test_chunks_and_stream_give_each_byte_once(spark, history_pool, tmp_path):
    paths, *_ = history_pool
    block_source.register(spark)
    given = {"paths": json.dumps(paths), "chunk": str(3 << 20), "overlap": "0", "refused": json.dumps({"1": [[100, 612]]})}
    rows = spark.read.format("blockmember").options(**given).load().collect()
    whole = b"".join(r.data for r in sorted((r for r in rows if r.member == 0), key=lambda r: r.off))
    assert whole == open(paths[0], "rb").read()
    assert [(r.off, [tuple(b) for b in r.bad]) for r in rows if r.bad] == [(0, [(0, 1024)])]  # whole sectors
    for _ in range(2):  # the second run finds all done in its checkpoint
        q = spark.readStream.format("blockmember").options(**given).load().selectExpr("member", "off", "length(data) n").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n"), F.count("*")).first()[:] == (2 * SIZE, 6)


def test_salvage_and_refusal(history_pool):
    m = Member(history_pool[0][0], [(512, 1024)])
    with pytest.raises(Refused):
        m.read(0, 1024)
    data, bad = m.salvage(0, 2048)
    assert bad == [(512, 512)] and data[512:1024] == bytes(512) and len(data) == 2048
    with pytest.raises(Refused):
        m.read(m.size - 10, 11)
    assert not hasattr(m, "write")


def test_twins_are_refused(spark, history_pool, tmp_path):
    paths, *_ = history_pool
    copy = tmp_path / "copy"
    copy.write_bytes(open(paths[0], "rb").read())
    with pytest.raises(assemble.Twins):
        commands.scan(spark, [*paths, str(copy)])


def test_carry_over_of_unread_parts(spark):
    """Names below a part that a version could not read are neither destroyed nor created again."""
    rows = [(v, g, n, False, False, 0, v, 1, 1, []) for v, g, n in ((1, 10, "p/a"), (1, 11, "p/a/x"), (1, 12, "p/b"), (2, 12, "p/b"), (3, 10, "p/a"), (3, 12, "p/b"), (4, 12, "p/b"))]
    states = spark.createDataFrame(rows, "txg long, guid long, name string, snapshot boolean, clone boolean, origin_obj long, creation_txg long, volsize long, volblocksize long, unknown array<string>")
    versions = spark.createDataFrame([(v,) for v in (1, 2, 3, 4)], "txg long")
    unread = spark.createDataFrame([(2, "p/a")], "txg long, prefix string")
    got = sorted((r.txg, r.kind, r.guid, r.last_seen) for r in history.events(states, versions, unread).collect())
    assert got == [(3, "destroyed", 11, 1), (4, "destroyed", 10, 3)]


def test_unknown_is_no_change(spark):
    rows = [(1, 5, "p/v", False, False, 9, 1, 100, 8, []), (2, 5, "p/v", False, False, 0, 1, None, 8, ["volsize"]), (3, 5, "p/v", False, False, 0, 1, 200, 16, [])]
    states = spark.createDataFrame(rows, "txg long, guid long, name string, snapshot boolean, clone boolean, origin_obj long, creation_txg long, volsize long, volblocksize long, unknown array<string>")
    versions = spark.createDataFrame([(v,) for v in (1, 2, 3)], "txg long")
    none = spark.createDataFrame([], "txg long, prefix string")
    got = sorted((r.txg, r.kind, r.details) for r in history.events(states, versions, none).collect())
    assert got == [(2, "promoted", None), (3, "property", "volblocksize: 8 -> 16")]


def test_abandoned_history(spark, tmp_path):
    b = Builder(str(tmp_path), "single", 1, size=SIZE)
    for txg, at in ((10, 100), (11, 300), (12, 200), (13, 400)):
        b.commit(txg, at, {"": ROOT})
    found, pool = scanned(spark, b.finish())
    assert [(r.txg, r.kind, r.details) for r in commands.timeline(spark, found, pool).collect()] == [(12, "abandoned", "older than version 11")]


def test_evidence_report(spark, tmp_path):
    a, b = str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")
    out = tmp_path / "vol.img"
    out.write_bytes(b"data")
    good = evidence.describe(str(out))
    record = {"ts": 5, "tool": "t", "version": "1", "argv": ["t", "dump"], "inputs": [{"path": "/x", "kind": "file", "size": 1, "sha256": "aa"}], "outputs": [good], "result": {"dataset": "p/v", "txg": 9, "sha256": good["sha256"], "blocks_zeroed": 0}, "status": 6}
    evidence.append(a, record)
    evidence.append(a, record)
    evidence.append(b, record)
    evidence.append(b, record | {"ts": 7, "version": "2", "status": 0, "inputs": [{"path": "/x", "kind": "file", "size": 1, "sha256": "bb"}, {"path": "/gone", "kind": "file", "size": 1}]})
    with open(b, "a") as f:
        f.write('{"v": 1, "ts"\n')
    got = commands.report_build(spark, [a, b])
    assert got["commands"].count() == 3  # the record in both logs counts once, its repeat within one log stays
    assert [(r.path, r.sha256, r.conflict) for r in got["evidence"].collect()] == [("/gone", None, False), ("/x", "aa", True)]
    assert [(r.complete, r.finished_later) for r in got["extractions"].collect()] == [(False, True), (False, True), (True, False)]
    assert [r.warning for r in got["warnings"].collect()] == ["input hash changed: /x", "log 1 line 3 is no record", "several versions of t"]
    verdicts = {r.path: r.status for r in commands.report_verify(spark, got).collect()}
    assert verdicts == {"/x": "MISSING", "/gone": "MISSING", str(out): "PASS"}
    out.write_bytes(b"date")
    assert {r.status for r in commands.report_verify(spark, got).filter("section = 'output'").collect()} == {"FAIL"}
    assert all(d.count() == 0 for d in commands.report_differences(got, commands.report_build(spark, [a, b])).values())
    assert "## warnings" in commands.markdown(got) and "\\/" not in commands.markdown(got)
    evidence.append(b, {"v": 2})
    with pytest.raises(Exception, match="record version"):
        commands.report_build(spark, [a, b])["commands"].collect()


def test_zero_points_and_pointers(spark, tmp_path):
    """A member inside a larger disk is found by its root pointers, and by what its pointers address."""
    b = Builder(str(tmp_path), "single", 1, size=SIZE)
    for txg in range(20, 30):
        b.commit(txg, txg * 10, {"": ROOT, "vol": Item(2, volume(txg, "off", "fletcher4", 8), 6)})
    (path,) = b.finish()
    shifted = str(tmp_path / "disk")
    with open(shifted, "wb") as f:
        f.write(bytes(3 << 20) + open(path, "rb").read())
    got = commands.zero_points(spark, [shifted]).collect()
    assert (got[0].base, got[0].anchors, got[0].labels, got[0].min_txg, got[0].max_txg) == (3 << 20, 20, [0, 1], 20, 29)
    assert commands.zero_points(spark, [shifted], psize=SIZE).first().anchors == 40
    bases = commands.base_by_pointers(spark, shifted, [n << 20 for n in range(5)]).collect()
    assert (bases[0].base, bases[0].clear) == (3 << 20, True) and bases[1].confirmed * 2 <= bases[0].confirmed and not bases[1].clear


def test_carved_roots(spark, history_pool):
    paths, *_ = history_pool
    _, pool = scanned(spark, paths)
    got = commands.carve_roots(spark, pool).collect()
    assert len(got) == 5 and got[0].datasets == 4 and {r.datasets for r in got} == {2, 3, 4}
    assert all(r.member == 0 for r in got)


def test_dump_reports_every_lost_block(spark, history_pool, tmp_path, monkeypatch):
    paths, *_ = history_pool
    found, pool = scanned(spark, paths)
    lost = spark.range(10_050).selectExpr("id as blkid", "id * 8192 as off", "'zeroed' as state", "cast(null as binary) as data", "'checksum' as reason")
    monkeypatch.setattr(commands, "read_volume", lambda *a, **b: lost)
    report = commands.dump(spark, found, pool, "tank/vol", str(tmp_path / "v"))
    assert report["blocks_zeroed"] == 10_050 and [x["blkid"] for x in report["bad"]] == list(range(10_050))


def test_resumed_dump(spark, history_pool, tmp_path):
    paths, vol, *_ = history_pool
    found, pool = scanned(spark, paths)
    out = str(tmp_path / "vol.img")
    first = commands.dump_resumable(spark, found, pool, "tank/vol", out, stretch=16, stop_after=1)
    assert (first["complete"], first["blocks_done"], first["status"]) == (False, 16, 6)
    done = commands.dump_resumable(spark, found, pool, "tank/vol", out, stretch=16)
    assert done["complete"] and done["sha256"] == hashlib.sha256(image_of(vol)).hexdigest() and open(out, "rb").read() == image_of(vol)
    with pytest.raises(ValueError, match="another volume"):
        commands.dump_resumable(spark, found, pool, "tank/new", out)
    with open(out, "r+b") as f:
        f.write(b"!")
    with pytest.raises(ValueError, match="has changed"):
        commands.dump_resumable(spark, found, pool, "tank/vol", out)


def test_bulk_dump_keeps_what_matches(spark, tmp_path):
    b = Builder(str(tmp_path), "single", 1, size=SIZE)
    one, two = volume(1, blocks=6), volume(2, blocks=6)
    b.commit(5, 50, {"": ROOT, "a": Item(2, None, 2), "a/b": Item(3, one, 3), "a_b": Item(4, two, 4), "other": Item(5, one, 4)})
    found, pool = scanned(spark, b.finish())
    folder = str(tmp_path / "out")
    got = commands.dump_all(spark, found, pool, "tank", folder)
    assert got["status"] == 0 and sorted(os.path.basename(v["output"]) for v in got["volumes"]) == ["tank_a_b-0000000000000003.img", "tank_a_b-0000000000000004.img", "tank_other.img"]
    os.remove(os.path.join(folder, "tank_other.img"))
    again = commands.dump_all(spark, found, pool, "tank", folder)
    assert {v["dataset"]: v["kept"] for v in again["volumes"]} == {"tank/a/b": True, "tank/a_b": True, "tank/other": False}
    assert [v["dataset"] for v in commands.dump_all(spark, found, pool, "tank/a", str(tmp_path / "p"))["volumes"]] == ["tank/a/b"]
    assert commands.exit_status([0, 4, 6]) == 6 and commands.exit_status([]) == 0


def test_pool_events(spark, history_pool):
    paths, *_ = history_pool
    found, pool = scanned(spark, paths)
    pool.hosts.insert(0, {"hostid": 7, "hostname": "old", "txg": 101})
    got = [(r.txg, r.kind) for r in commands.timeline(spark, found, pool, about="tank/fs", with_pending=True).collect()]
    assert got == [(100, "pending"), (101, "pending"), (102, "pending"), (103, "pending"), (104, "pending")]
    assert (101, "host") in [(r.txg, r.kind) for r in commands.timeline(spark, found, pool).collect()]


def test_hints_binding_and_order(tmp_path):
    b = Builder(str(tmp_path), "raidz", 4, 1, size=SIZE)
    b.commit(7, 10, {"": ROOT, "vol": Item(2, volume(), 6)})
    paths = b.finish()
    devices = [assemble.scan(p, i) for i, p in enumerate(paths)]
    root = next(s.ub for s in devices[0].labels[0].slots if s.status == "verified").rootbp
    text = json.dumps({"name": "tank", "tops": [{"kind": "raidz", "ashift": 9, "nparity": 1, "leaves": [{"path": p} for p in paths]}]})
    pool = layout.hints(text, paths)
    assert layout.readable_blocks(pool, root) > 3
    with pytest.raises(ValueError, match="unknown key"):
        layout.hints(text.replace('"ashift"', '"ashft"'), paths)
    wrong = layout.hints(json.dumps({"name": "tank", "tops": [{"kind": "raidz", "ashift": 9, "nparity": 1, "leaves": [{"path": paths[k]} for k in (2, 0, 1, 3)]}]}), paths)
    best = layout.search_order(wrong, 0, root)
    assert best[0][1] == (0, 1, 2, 3) and best[0][0] > best[1][0]
    vacant = layout.hints(json.dumps({"name": "tank", "tops": [{"kind": "raidz", "ashift": 9, "nparity": 1, "leaves": [{"path": paths[0]}, {}, {"path": paths[2]}, {}]}]}), paths[:3])
    bound = layout.bind(vacant, paths[3], root)
    assert [x.member for x in bound.tops[0].leaves] == [0, None, 2, 3]
    with pytest.raises(layout.Ambiguous):
        layout.bind(vacant, os.devnull, root)
    assert layout.base_candidates(10 << 20, 8 << 20) == [0, 1 << 20, 2 << 20]


def test_label_export(tmp_path):
    b = Builder(str(tmp_path), "mirror", 2, size=SIZE)
    b.commit(7, 10, {"": ROOT})
    paths = b.finish()
    label = assemble.scan(paths[0], 0).labels[2]
    image_ = open(paths[0], "rb").read()
    front = layout.label_front(label.config, 2, SIZE)
    assert front[16 << 10 :] == image_[label.offset + (16 << 10) : label.offset + (128 << 10)]


def test_removed_device_reads_through_its_mapping(tmp_path):
    """A pointer to a removed device is followed to where its contents went."""
    b = Builder(str(tmp_path), "single", 1, size=SIZE)
    b.commit(7, 10, {"": ROOT, "vol": Item(2, volume(), 6)})
    paths = b.finish()
    pool = assemble.choose(assemble.assemble([assemble.scan(paths[0], 0)])).pool
    r = reader.Reader(pool)
    data = next(d for _, d in r.copies(Dva(0, 512, 4096, False), 4096))
    pool.mappings[9] = dsl_decode.indirect(dsl_decode.build_indirect([(1 << 20, 1024, 0, 512), ((1 << 20) + 1024, 3072, 0, 1536)]), 2)
    assert [d for _, d in r.copies(Dva(9, 1 << 20, 4096, False), 4096)] == [data]
    with pytest.raises(Damage):
        list(r.copies(Dva(9, 0, 512, False), 512))


def test_gang_blocks(tmp_path):
    """A block in pieces: a sealed header of pointers, read in order."""
    b = Builder(str(tmp_path), "single", 1, size=SIZE)
    b.commit(7, 10, {"": ROOT})
    data = random.Random(1).randbytes(1536)
    parts = [b.write(data[i : i + 512], 23) for i in range(0, 1536, 512)]
    at = b.next
    head = checksums.seal(b"".join(parts) + bytes(128), 0, at, 7)
    b._place(head)
    bp = blocks.blkptr(blocks.build_blkptr([Dva(0, at, 512, True)], 1536, 1536, 2, 7, 23, 0, 7, 1, checksums.fletcher4(data)))
    r = reader.Reader(assemble.choose(assemble.assemble([assemble.scan(p, i) for i, p in enumerate(b.finish())])).pool)
    assert r.block(bp) == data
    broken = blocks.blkptr(blocks.build_blkptr([Dva(0, at, 512, True)], 1536, 1536, 2, 7, 23, 0, 8, 1, checksums.fletcher4(data)))
    with pytest.raises(Damage):
        r.block(broken)


@pytest.mark.parametrize("suite", [3, 5, 6, 8])
def test_encrypted_volume(spark, tmp_path, suite):
    rnd = random.Random(suite)
    key = Key(suite, rnd.randbytes({3: 16, 5: 32, 6: 16, 8: 32}[suite]), b"open sesame")
    b = Builder(str(tmp_path), "single", 1, size=SIZE)
    vol = volume(1, "lz4", "sha256", 8)
    vol.key = key
    b.commit(7, 10, {"": ROOT, "vol": Item(2, vol, 6)})
    found, pool = scanned(spark, b.finish())
    out = str(tmp_path / "v")
    assert commands.dump(spark, found, pool, "tank/vol", out, key="passphrase:open sesame")["status"] == 0
    assert open(out, "rb").read() == image_of(vol)
    locked = commands.dump(spark, found, pool, "tank/vol", out + "2")
    assert locked["blocks_read"] == 0 and locked["bad"][0]["reason"] == "the block is encrypted"
    with pytest.raises(Damage, match="authentication"):
        commands.dump(spark, found, pool, "tank/vol", out + "3", key="passphrase:wrong")


@pytest.mark.parametrize("checksum", ["skein", "blake3"])
def test_salted_checksums(tmp_path, checksum):
    b = Builder(str(tmp_path), "single", 1, size=SIZE)
    b.salt = bytes(range(32))
    vol = Volume(8192, 2048, {0: b"x" * 2048, 2: random.Random(1).randbytes(2048)}, "off", checksum)
    b.commit(7, 10, {"": ROOT, "vol": Item(2, vol, 6)})
    device = assemble.scan(b.finish()[0], 0)
    r = reader.Reader(assemble.choose(assemble.assemble([device])).pool)
    root = next(s.ub for s in device.labels[0].slots if s.status == "verified").rootbp
    ds = next(d for d in datasets.Meta(r, root).walk("tank").datasets if d.name == "tank/vol")
    obj, _ = datasets.volume(r, ds)
    assert b"".join(obj.read(i) for i in range(4)) == image_of(vol)
    r.pool.salt = None
    with pytest.raises(Damage):
        obj.read(0)


@pytest.mark.parametrize(("kind", "disks", "parity"), [("mirror", 2, 0), ("raidz", 4, 1)])
def test_copies_with_different_gaps_are_merged(spark, tmp_path, kind, disks, parity):
    """Every member refuses some sectors of one block, no two the same ones."""
    b = Builder(str(tmp_path), kind, disks, parity, size=SIZE)
    vol = Volume(8192, 8192, {0: random.Random(1).randbytes(8192)}, "off", "sha256")
    b.commit(7, 10, {"": ROOT, "vol": Item(2, vol, 6)})
    if kind == "mirror":
        at = b.images[0].find(vol.blocks[0])
        refused = {0: [(at, at + 512)], 1: [(at + 1024, at + 2048)]}
    else:
        starts = [(i, image_.find(vol.blocks[0][k * 512 : (k + 1) * 512])) for k in (0, 7) for i, image_ in enumerate(b.images) if image_.find(vol.blocks[0][k * 512 : (k + 1) * 512]) >= 0]
        refused = {i: [(at, at + 512)] for i, at in starts}
        assert len(refused) == 2
    found, pool = scanned(spark, b.finish(), refused=refused)
    report = commands.dump(spark, found, pool, "tank/vol", str(tmp_path / "v"))
    assert open(tmp_path / "v", "rb").read() == vol.blocks[0]
    assert (report["blocks_salvaged"], report["blocks_zeroed"]) == (1, 0)


def test_ledger():
    strict, lenient = medium.Ledger(clock=lambda: 5), medium.Ledger(may_fail=True, clock=lambda: 5)
    with pytest.raises(medium.Stopped):
        strict.refused(0, 512, 512)
    with pytest.raises(medium.Stopped):
        strict.check(0)
    strict.check(1)
    for k in range(8):
        assert not lenient.refused(0, 512 * k, 512).stopped
    with pytest.raises(medium.Stopped):
        lenient.refused(0, 0, 512)
    assert lenient.incidents[0].as_json()["lba"] == 0 and "counts as lost" not in strict.incidents[0].text()


def test_display(tmp_path):
    assert display.command_line(["dump", "a b", "it's"]) == "dump 'a b' 'it'\"'\"'s'"
    assert display.hexdump(b"abc\0" * 5, 16, 16).splitlines() == ["00000010  61 62 63 00 61 62 63 00 61 62 63 00 61 62 63 00  abc.abc.abc.abc.", "... 4 more bytes"]
    assert display.device_number(0x0801) == (8, 1) and display.device_number(5 << 32 | 7, "illumos") == (5, 7)
    assert display.path_text(b"a\xff") == ("a�", "61ff") and display.path_text(b"ab") == ("ab", None)
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.img").write_text("1")
    (tmp_path / "b.img").write_text("2")
    assert display.rebase(["/old/x/a.img", "/old/y/b.img", "/other/b.img", "/old/none"], str(tmp_path)) == {"/old/x/a.img": str(tmp_path / "x/a.img"), "/old/y/b.img": None, "/other/b.img": None, "/old/none": None}
    assert display.b64_decode(display.b64_encode(b"\0x")) == b"\0x" and display.from_hex("0aFF") == b"\n\xff"
    with pytest.raises(ValueError):
        display.from_hex("abc")
    assert "/dev/gpt/tank-d0" in display.disk_names("/evidence/d.img", ["tank-d0"])


def test_devices_beneath(tmp_path):
    base = tmp_path / "block"
    for name in ("sda", "dm-0"):
        (base / name / "slaves").mkdir(parents=True)
    (base / "sda" / "sda1").mkdir()
    (base / "sda" / "sda1" / "partition").write_text("1")
    os.symlink(base / "sda" / "sda1", base / "sda1")
    (base / "dm-0" / "slaves" / "sda1").mkdir()
    assert medium.beneath("/dev/dm-0", str(base)) == ["sda1", "sda"]


def test_volume_on_a_removed_device(spark, tmp_path):
    b = Builder(str(tmp_path), "mirror", 2, size=SIZE)
    vol = volume(9, "lz4", "sha256", 12)
    vol.removed = 1
    b.commit(7, 10, {"": ROOT, "vol": Item(2, vol, 6)})
    found, pool = scanned(spark, b.finish())
    assert commands.dump(spark, found, pool, "tank/vol", str(tmp_path / "v"))["status"] == 0
    assert open(tmp_path / "v", "rb").read() == image_of(vol)
    assert list(pool.pool.mappings) == [1] and len(b.moved[1]) == 4


def test_files_with_registered_attributes(spark, tmp_path):
    """Attributes placed by a layout, a link's target among them, extended attributes in a spill block, and case-folded and normalised lookups."""
    b = Builder(str(tmp_path), "mirror", 2, size=SIZE)
    content = Files({"dir/Straße": b"data", "dir/café": b"x" * 5000}, {"ln": "dir/Straße"}, attributes=True, xattrs={"dir/café": {"user.one": b"1", "user.two": b"22"}})
    b.commit(9, 10, {"": ROOT, "fs": Item(3, content, 5)})
    found, pool = scanned(spark, b.finish())
    rows = {r.path: r for r in commands.list_files(found, pool, spark, "tank/fs").collect()}
    assert list(rows) == ["", "dir", "dir/Straße", "dir/café", "ln"] and all(r.error is None for r in rows.values())
    assert (rows["dir/café"].size, rows["dir/café"].uid, rows["dir/café"].mtime, rows["dir/café"].mode) == (5000, 1000, 1_700_000_001, 0o100644)
    _, ds, r = commands._find(pool, commands.candidates(found, pool), "tank/fs")
    fs = Filesystem(r, ds)
    number = fs.lookup("dir/café".encode())
    assert fs.lookup("DIR/cafe\u0301".encode()) == number and fs.lookup("dir/STRASSE".encode()) == fs.lookup("dir/Straße".encode())
    z = fs.znode(fs.objects.get(number))
    assert fs.xattrs(z) == {"user.one": b"1", "user.two": b"22"}
    link = fs.lookup(b"ln")
    assert fs.symlink(link, fs.znode(fs.objects.get(link))) == "dir/Straße".encode()
    out = tmp_path / "tree"
    commands.extract_files(found, pool, spark, "tank/fs", str(out)).collect()
    assert (out / "dir" / "Straße").read_bytes() == b"data" and os.readlink(out / "ln") == "dir/Straße"
    with pytest.raises(Damage, match="does not exist"):
        fs.lookup(b"dir/none")


@pytest.mark.parametrize("suite", [5, 8])
def test_encrypted_files(spark, tmp_path, suite):
    """Names, attributes and contents of an encrypted file system need its key; a forged attribute is refused."""
    key = Key(suite, random.Random(1).randbytes(32), b"open sesame")
    b = Builder(str(tmp_path), "single", 1, size=SIZE)
    content = Files({"dir/a": b"data", "dir/b": b"x" * 5000}, {"ln": "dir/a"}, attributes=True, xattrs={"dir/b": {"user.one": b"1"}}, key=key)
    b.commit(9, 10, {"": ROOT, "fs": Item(3, content, 5)})
    found, pool = scanned(spark, b.finish())
    with pytest.raises(Exception, match="the block is encrypted"):
        commands.list_files(found, pool, spark, "tank/fs").collect()
    spec = "passphrase:open sesame"
    rows = {r.path: (r.kind, r.size, r.error) for r in commands.list_files(found, pool, spark, "tank/fs", key=spec).collect()}
    assert rows == {"": ("dir", 3 + 1, None), "dir": ("dir", 4, None), "dir/a": ("file", 4, None), "dir/b": ("file", 5000, None), "ln": ("symlink", 5, None)}
    out = tmp_path / "tree"
    commands.extract_files(found, pool, spark, "tank/fs", str(out), key=spec).collect()
    assert (out / "dir" / "a").read_bytes() == b"data" and (out / "dir" / "b").read_bytes() == b"x" * 5000 and os.readlink(out / "ln") == "dir/a"
    nodes = blocks.build_dnode(19, 512, 1, 12, 0, [bytes(128)], 44, b"secret attributes") + bytes(512)
    sealed, tag = crypt.seal_dnodes(suite, crypt.block_key(key.master, b"s" * 8), b"i" * 12, nodes)
    pointer = bytes(32) + b"s" * 8 + b"i" * 8 + bytes(44) + b"i" * 4 + bytes(16) + tag
    assert b"secret" not in sealed and crypt.decrypt_dnodes(suite, key.master, pointer, sealed) == nodes
    forged = bytearray(sealed)
    forged[20] ^= 1
    with pytest.raises(Damage):
        crypt.decrypt_dnodes(suite, key.master, pointer, bytes(forged))
