import itertools
import random
import zlib

import numpy as np
import pytest

from lodewell.decode import Damage, blocks, carve, checksums, compress, draid, dsl, media, raidz, zap
from lodewell.decode import nvlist as nv


def samples():
    rnd = random.Random(1)
    for _ in range(60):
        yield b"".join(rnd.choice([bytes([rnd.randrange(256)]) * rnd.randrange(1, 400), rnd.randbytes(rnd.randrange(1, 300)), bytes(rnd.randrange(300))]) for _ in range(rnd.randrange(1, 8)))


@pytest.mark.parametrize("codec", ["gzip-6", "zstd", "lz4", "zle", "lzjb"])
def test_codecs_round_trip_and_refuse_wrong_sizes(codec):
    for data in samples():
        packed = compress.compress(codec, data)
        code = compress.CODES[codec]
        assert compress.decompress(code, packed, len(data)) == data
        assert compress.could_start(codec.split("-")[0], packed.ljust(len(data) + 64, b"\0"), len(data) + 64)
        with pytest.raises(Damage):
            compress.decompress(code, packed[: len(packed) // 2], len(data))


def test_lz4_has_exactly_its_size():
    for data in samples():
        body = compress.compress("lz4", data)[4:]
        assert compress.lz4_block(body, len(data)) == data
        for wrong in (len(data) - 1, len(data) + 1, len(data) + 300, 0):
            if 0 <= wrong != len(data):
                with pytest.raises(Damage):
                    compress.lz4_block(body, wrong)
    assert compress.lz4_block(b"\0", 0) == b""


def test_known_blocks():
    assert compress.lz4_block(bytes.fromhex("10610100") + b"\x50aaaaa", 10) == b"a" * 10
    assert compress.lzjb(b"\x02a\x00\x01", 4) == b"aaaa"
    assert compress.zle(bytes([2, 1, 2, 3, 64]), 4) == b"\x01\x02\x03\x00"


def test_decoders_never_read_outside():
    rnd = random.Random(3)
    for _ in range(400):
        junk = rnd.randbytes(rnd.randrange(0, 600))
        for decode in (lambda b: compress.lz4(b, 4096), lambda b: compress.lzjb(b, 4096), lambda b: compress.zle(b, 4096), lambda b: compress.zstd(b, 4096), lambda b: compress.gzip(b, 4096), nv.parse, lambda b: blocks.dnode(b), lambda b: blocks.blkptr(b), lambda b: zap.leaf(b.ljust(4096, b"\1")), lambda b: dsl.dataset(b), lambda b: dsl.directory(b)):
            try:
                decode(junk)
            except Damage:
                pass


def test_fletcher_definitions():
    rnd = random.Random(5)
    data = rnd.randbytes(300_000)

    a = b = c = d = 0
    for i in range(0, len(data), 4):
        a = (a + int.from_bytes(data[i : i + 4], "little")) % (1 << 64)
        b, c = (b + a) % (1 << 64), (c + b + a) % (1 << 64)
        d = (d + c) % (1 << 64)
    assert checksums.fletcher4(data) == (a, b, c, d)
    a0 = a1 = b0 = b1 = 0
    for i in range(0, len(data) // 16 * 16, 16):
        a0 = (a0 + int.from_bytes(data[i : i + 8], "little")) % (1 << 64)
        a1 = (a1 + int.from_bytes(data[i + 8 : i + 16], "little")) % (1 << 64)
        b0, b1 = (b0 + a0) % (1 << 64), (b1 + a1) % (1 << 64)
    assert checksums.fletcher2(data) == (a0, a1, b0, b1)


def test_digest_words_known_answers():
    # SHA-256 and SHA-512/256 of "abc", from the published standard.
    assert checksums.sha256(b"abc")[0] == 0xBA7816BF8F01CFEA
    assert checksums.sha512_256(b"abc")[0] == int.from_bytes(bytes.fromhex("53048e2681941ef9"), "little")


def test_verdicts_are_four_valued():
    data = b"x" * 512
    good = checksums.fletcher4(data)
    assert checksums.verdict(7, data, good) == "Ok"
    assert checksums.verdict(7, data, (1, 2, 3, 4)) == "Mismatch"
    assert checksums.verdict(2, data, (0, 0, 0, 0)) == "NotChecked"
    assert checksums.verdict(14, data, good) == checksums.verdict(13, data, good, salt=bytes(32)) == "Unsupported"
    for name in ("skein", "blake3"):
        assert checksums.verdict(checksums.CODES[name], data, checksums.compute(name, data, salt=b"s" * 32), salt=b"s" * 32) == "Ok"
    assert checksums.verdict(7, data, (*good[:2], 0, 0), crypt=True) == "Ok"
    block = checksums.seal(bytes(1024), 5)
    assert [checksums.embedded_verdict(x, o) for x, o in ((block, 5), (block, 6), (bytes(1024), 5))] == ["Ok", "Mismatch", "NotChecked"]


def test_nvlist_round_trip_and_limits():
    tree = nv.of(a=1, s="x", sub=nv.of(z=[1, 2], f=True), lst=[nv.of(q=5), nv.of()], raw=b"\1\2\3")
    assert nv.parse(nv.build(tree)) == tree
    assert nv.u64(tree, "a") == 1 and nv.u64(tree, "s") is None and nv.flag(nv.child(tree, "sub"), "f")
    assert ("/lst[0]/q", nv.UINT64, "5") in nv.flatten(tree)
    deep = nv.of(x=1)
    for _ in range(40):
        deep = nv.of(d=deep)
    with pytest.raises(Damage):
        nv.parse(nv.build(deep))


def test_pointers():
    dvas = [blocks.Dva(3, 9 << 20, 8192, False), blocks.Dva(0, 512, 1024, True)]
    bp = blocks.blkptr(blocks.build_blkptr(dvas, 131072, 8192, 15, 7, 23, 2, 99, 5, (1, 2, 3, 4)))
    assert (list(bp.live), bp.lsize, bp.psize, bp.compression, bp.checksum, bp.type, bp.level, bp.birth, bp.fill, bp.cksum) == (dvas, 131072, 8192, 15, 7, 23, 2, 99, 5, (1, 2, 3, 4))
    embedded = blocks.blkptr(blocks.build_embedded(b"hello" * 20, 512, 2, 20, 7))
    assert embedded.payload == b"hello" * 20 and embedded.lsize == 512 and not embedded.hole
    assert blocks.blkptr(bytes(128)).hole
    assert blocks.object_type(23) == "zvol" and blocks.object_type(0xC4).startswith("zap")
    assert blocks.dirent(8 << 60 | 77) == (77, 8)
    assert blocks.describe_property("compression", 15) == "lz4" and blocks.describe_property("volsize", 15) is None


def test_maps():
    assert {e.name: e.number for e in zap.micro(zap.build_micro({"a": 5, "root": 32}))} == {"a": 5, "root": 32}
    head, leaf = zap.build_fat({"x": 1, "a long name that spans more than one chunk": "and a text that does so too", "arr": [1, 2, 3]})
    found = {e.name: e for e in zap.leaf(leaf)}
    assert found["x"].number == 1 and found["arr"].ints == (1, 2, 3) and found["a long name that spans more than one chunk"].text == "and a text that does so too"
    assert zap.header(head).entries == 3


def test_space_logs_and_mappings():
    steps = [("alloc", 0, 4096), ("free", 512, 1024), ("alloc", 1 << 20, 512)]
    for wide in (False, True):
        assert [(s.kind, s.offset, s.run) for s in dsl.space_log(dsl.build_space_log(steps, 9, wide), 9)] == steps
    mapped = dsl.indirect(dsl.build_indirect([(4096, 512, 2, 0), (0, 4096, 1, 8192)]), 2)
    assert mapped.remap(1024, 3584) == [(1, 9216, 3072), (2, 0, 512)]
    for offset, size in ((4096, 1024), (9999, 1)):
        with pytest.raises(Damage):
            mapped.remap(offset, size)


def test_parity_rebuilds_every_loss():
    rnd = random.Random(3)
    for n, parity in itertools.product((1, 2, 5, 9), (1, 2, 3)):
        sizes = [1024] * (n - n // 2) + [512] * (n // 2)
        data = [rnd.randbytes(s) for s in sizes]
        made = raidz.generate(data, parity)
        for k in range(min(parity, n) + 1):
            for missing in itertools.combinations(range(n), k):
                for lost in itertools.combinations(range(parity), parity - k):
                    left = [None if i in missing else x for i, x in enumerate(data)]
                    kept = [None if i in lost else x for i, x in enumerate(made)]
                    assert raidz.reconstruct(left, kept, sizes) == data
    with pytest.raises(Damage):
        raidz.reconstruct([None, None], [b"x"], [1, 1])


def test_field():
    assert all(raidz.multiply(a, raidz.inverse(a)) == 1 for a in range(1, 256))
    assert raidz.power(2, 8) == 0x1D


def test_columns_cover_a_block_once():
    rnd = random.Random(9)
    for _ in range(300):
        children, parity = rnd.randrange(3, 10), rnd.randrange(1, 3)
        psize = rnd.randrange(1, 256) * 512
        layout = raidz.columns(rnd.randrange(1 << 20) << 9, psize, 9, children, parity)
        assert sum(c.size for c in layout[parity:]) == psize
        assert len({c.child for c in layout}) == len(layout)
        assert all(c.size >= layout[-1].size for c in layout[:parity])
        assert raidz.asize(psize, 9, children, parity) >= sum(c.size for c in layout)


def test_single_parity_swaps_by_megabyte():
    plain, swapped = raidz.columns(0, 1024, 9, 3, 1), raidz.columns(1 << 20, 1024, 9, 3, 1)
    first = (1 << 20 >> 9) % 3
    assert plain[0].child == 0 and swapped[0].child == (first + 1) % 3 and swapped[1].child == first


def test_imager_maps():
    rows = media.imager_map("# comment\n0x0 ? 1\n0x00 0x10 +\n0x20 0x10 -\n", 0x40)
    assert rows == [(0, 16, "+"), (16, 16, "?"), (32, 16, "-"), (48, 16, "?")]
    assert media.refused(rows, 0x18, 0x10) == [(24, 40)]
    for text in ("0 ?\n0 0x10 +\n8 0x10 +\n", "0 ?\nx y z\n", "0 ?\n0 1 @\n"):
        with pytest.raises(Damage):
            media.imager_map(text)


def gpt_disk(sector, backup=False):
    entry = bytes.fromhex("c38c896ad21db211") + bytes.fromhex("99a6080020736631")[:8] + bytes(range(16)) + (40).to_bytes(8, "little") + (99).to_bytes(8, "little") + bytes(8) + "pool".encode("utf-16-le").ljust(72, b"\0")
    entries = entry.ljust(128, b"\0") + bytes(127 * 128)
    size = 200 * sector
    table = 2 if not backup else 200 - 1 - len(entries) // sector
    head = bytearray(b"EFI PART" + bytes.fromhex("00000100") + (92).to_bytes(4, "little") + bytes(8) + bytes(48) + table.to_bytes(8, "little") + (128).to_bytes(4, "little") + (128).to_bytes(4, "little") + zlib.crc32(entries).to_bytes(4, "little"))
    head[16:20] = zlib.crc32(bytes(head)).to_bytes(4, "little")
    disk = bytearray(size)
    at = sector if not backup else size - sector
    disk[at : at + 92] = head
    disk[table * sector : table * sector + len(entries)] = entries
    return bytes(disk)


@pytest.mark.parametrize("sector", [512, 4096])
@pytest.mark.parametrize("backup", [False, True])
def test_partition_tables(sector, backup):
    disk = gpt_disk(sector, backup)
    found = media.partitions(lambda at, n: disk[at : at + n], len(disk))
    assert [(p.start, p.length, p.name, p.pool) for p in found] == [(40 * sector, 60 * sector, "pool", True)]
    broken = disk.replace(b"EFI PART", b"EFI PXRT")
    assert media.partitions(lambda at, n: broken[at : at + n], len(broken)) == []


def test_signatures():
    disk = bytearray(1 << 17)
    disk[1080:1082], disk[1028:1032] = b"\x53\xef", (1000).to_bytes(4, "little")
    disk[1144:1148] = b"root"
    found = media.signatures(lambda at, n: bytes(disk[at : at + n]))
    assert [(f.kind, f.size, f.label) for f in found] == [("ext", 1024000, "root")]


def test_every_signature():
    """Each kind alone, built by its published layout; an empty volume has none."""

    def disk(*parts):
        out = bytearray(0x11000)
        for at, data in parts:
            out[at : at + len(data)] = data
        return lambda at, n: bytes(out[at : at + n])

    def le(value, n):
        return value.to_bytes(n, "little")

    cases = {
        "ext": (disk((1080, b"\x53\xef"), (1028, le(1000, 4)), (1048, le(2, 4)), (1144, b"root")), 1080, 4096000, "root"),
        "swap": (disk((4086, b"SWAPSPACE2"), (1028, le(99, 4)), (1052, b"sw")), 4086, 409600, "sw"),
        "xfs": (disk((0, b"XFSB"), (4, (4096).to_bytes(4, "big")), (8, (50).to_bytes(8, "big")), (108, b"data")), 0, 204800, "data"),
        "btrfs": (disk((0x10040, b"_BHRfS_M"), (0x10070, le(1 << 30, 8)), (0x1012B, b"vol")), 0x10040, 1 << 30, "vol"),
        "ntfs": (disk((3, b"NTFS    "), (11, le(512, 2)), (40, le(800, 8))), 3, 409600, ""),
        "fat32": (disk((82, b"FAT32   "), (11, le(512, 2)), (32, le(900, 4)), (71, b"USB        ")), 82, 460800, "USB"),
        "ufs2": (disk((65536 + 1372, le(0x19540119, 4)), (65536 + 680, b"ufs")), 65536 + 1372, None, "ufs"),
        "luks": (disk((0, b"LUKS\xba\xbe")), 0, None, ""),
        "gpt": (disk((512, b"EFI PART")), 512, None, ""),
        "pool": (disk((16384, b"\1\1\0\0")), 16384, None, ""),
    }
    for kind, (read, at, size, label) in cases.items():
        assert [(f.kind, f.offset, f.size, f.label) for f in media.signatures(read)] == [(kind, at, size, label)]
    assert media.signatures(disk()) == []


def test_a_pool_inside_a_volume(tmp_path):
    from lodewell.fixtures.builder import Builder

    b = Builder(str(tmp_path), "single", 1, size=8 << 20)
    path = b.finish()[0]
    with open(path, "rb") as f:
        data = f.read(0x11000)
    assert [x.kind for x in media.signatures(lambda at, n: data[at : at + n])] == ["pool"]


def test_first_structural_reason():
    node = blocks.build_dnode(23, 8192, 1, 17, 0, [blocks.build_blkptr([blocks.Dva(0, 4096, 8192, False)], 8192, 8192, 2, 7, 23, 0, 50, 1, (0, 0, 0, 0))])
    assert carve.judge(node)[1] is None

    def changed(**at):
        out = bytearray(node)
        for k, v in at.items():
            out[int(k[1:])] = v
        return carve.judge(bytes(out))[1]

    assert [changed(_0=0), changed(_0=70), changed(_1=8), changed(_2=9, _1=99), changed(_3=4), changed(_8=0, _9=0), changed(_11=9)] == ["free", "dnode_type", "indblkshift", "indblkshift", "nblkptr", "datablkszsec", "bonuslen"]
    d = carve.judge(node)[0]
    assert carve.Profile(type=19, volblocksize=8192, levels=2, txg=(0, 10)).misses(d) == ["profile_type", "profile_levels", "profile_txg"]
    assert carve.score(d) == 1.0
    assert carve.rank(1.0, None, False) == 0.45 and carve.rank(0.0, None, True) == 0.55


def test_feature_support():
    assert dsl.feature_support("com.delphix:hole_birth") == ("Yes", None)
    assert dsl.feature_support("org.openzfs:raidz_expansion")[0] == "No" and dsl.feature_support("x:y") == ("Unknown", None)


def test_distributed_parity_tables():
    """Every table generates to its recorded checksum, and places data without overlap."""
    for children, (count, seed, word) in draid.MAPS.items():
        table = draid.permutations(children, count, seed)
        assert checksums.fletcher4(table.tobytes())[0] == word
        assert (np.sort(table, axis=1) == np.arange(children)).all()
    layout = draid.Layout(3, 2, 1, 11, 2)
    used, at = set(), 0
    rnd = random.Random(1)
    for _ in range(60):
        psize = rnd.randrange(1, 40) * 4096
        for row in layout.rows(at, psize, 12):
            assert len({c.child for c in row}) == layout.width
            for c in row:
                cells = {(c.child, c.offset + k) for k in range(0, c.size, 4096)}
                assert not cells & used
                used |= cells
        assert sum(c.size for row in layout.rows(at, psize, 12) for c in row[2:]) == psize
        at += layout.asize(psize, 12)
    edge = layout.group_size - layout.asize(4096 * 3, 12)
    assert len(layout.rows(edge, 4096 * 6, 12)) == 2 and len(layout.rows(edge, 4096 * 3, 12)) == 1
    assert {layout.spare(0, k * layout.slice_size) for k in range(400)} == set(range(11)) and layout.spare(1, 0) is None
    with pytest.raises(Damage):
        draid.Layout(3, 2, 1, 10, 1)
