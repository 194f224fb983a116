"""Catalogue queries that run the decoders: each row's bytes are put together by column expressions and decoded on the executors.

The SQL of a query has the fields as numbers, straight from the tables, and
knows no byte of the format; so a field that is encoded or decoded in the
wrong place, width or order shows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..decode import blocks, checksums, compress, dsl, media, nvlist, raidz, zap
from .catalog import query, t

#: Rows of bytes that a task turns into Python objects at a time.
SLICE = 512


def number(value: Column | int, n: int = 8, little: bool = True) -> Column:
    """An unsigned number of ``n`` bytes, as hex digits."""
    digits = F.lpad(F.hex((F.lit(value) if isinstance(value, int) else value).cast("long")), 2 * n, "0")
    return F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n)))) if little else digits


def zeros(n: int) -> Column:
    return F.lit("00" * n)


def raw(*parts: Column) -> Column:
    return F.unhex(F.concat(*parts)).alias("raw")


def decoded(df: DataFrame, fn: Callable[..., list[dict]], schema: str) -> DataFrame:
    """The rows that ``fn`` makes of each row, given as keyword arguments."""
    target = _parse_datatype_string(schema)
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = [x for row in batch.slice(at, SLICE).to_pylist() for x in fn(**row)]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.mapInArrow(run, target)


def pointer(vdev, asize, offset, lsize, psize, compression, checksum, kind, level, birth, fill, word) -> list[Column]:
    """The hex digits of a block pointer with one copy; sizes and offsets in sectors, sizes less one as stored."""
    prop = [number(lsize - 1, 2), number(psize - 1, 2), number(compression, 1), number(checksum, 1), number(kind, 1), number(F.lit(0x80) + level, 1)]
    return [number(asize, 4), number(vdev, 4), number(offset), zeros(32), *prop, zeros(24), number(birth), number(fill), number(word), zeros(24)]


_POINTER_SQL = """l_orderkey, l_linenumber, l_suppkey % 16 as vdev, l_partkey * 4096 as dva_offset, (l_linenumber + 8) * 512 as asize,
(l_orderkey % 256 + 1) * 512 as lsize, (l_partkey % 128 + 1) * 512 as psize, l_linenumber + 1 as compression, l_linenumber % 5 + 5 as checksum,
l_suppkey % 50 + 1 as type, l_orderkey % 6 as level, l_orderkey + 7 as birth, l_partkey as fill, l_orderkey * 1000003 as word"""


@query(f"select {_POINTER_SQL} from lineitem")
def q_decode_blkptr(spark, d):
    c = F.col
    fields = pointer(c("l_suppkey") % 16, c("l_linenumber") + 8, c("l_partkey") * 8, c("l_orderkey") % 256 + 1, c("l_partkey") % 128 + 1, c("l_linenumber") + 1, c("l_linenumber") % 5 + 5, c("l_suppkey") % 50 + 1, c("l_orderkey") % 6, c("l_orderkey") + 7, c("l_partkey"), c("l_orderkey") * 1000003)

    def fn(l_orderkey, l_linenumber, raw):
        bp = blocks.blkptr(raw)
        (one,) = bp.live
        return [{"l_orderkey": l_orderkey, "l_linenumber": l_linenumber, "vdev": one.vdev, "dva_offset": one.offset, "asize": one.asize, "lsize": bp.lsize, "psize": bp.psize, "compression": bp.compression, "checksum": bp.checksum, "type": bp.type, "level": bp.level, "birth": bp.birth, "fill": bp.fill, "word": bp.cksum[0]}]

    rows = t(spark, d, "lineitem").select(c("l_orderkey").cast("long"), c("l_linenumber").cast("long"), raw(*fields))
    return decoded(rows, fn, "l_orderkey long, l_linenumber long, vdev long, dva_offset long, asize long, lsize long, psize long, compression long, checksum long, type long, level long, birth long, fill long, word long")


@query("""select o_orderkey, o_custkey % 53 + 1 as type, (o_custkey % 32 + 1) * 512 as blocksize, o_orderkey % 1000 as maxblkid,
(o_orderkey % 1000 + 1) * ((o_custkey % 32 + 1) * 512) as size, o_orderkey * 512 as used, o_custkey * 4096 as first_offset, 8 as bonus_len from orders""")
def q_decode_dnode(spark, d):
    c = F.col
    first = pointer(F.lit(0), F.lit(8), c("o_custkey") * 8, F.lit(1), F.lit(1), F.lit(2), F.lit(7), F.lit(19), F.lit(0), c("o_orderkey"), F.lit(1), F.lit(0))
    head = [number(c("o_custkey") % 53 + 1, 1), F.lit("110101"), F.lit("2C000001"), number(c("o_custkey") % 32 + 1, 2), number(8, 2), zeros(4), number(c("o_orderkey") % 1000), number(c("o_orderkey") * 512), zeros(32)]

    def fn(o_orderkey, raw):
        x = blocks.dnode(raw)
        return [{"o_orderkey": o_orderkey, "type": x.type, "blocksize": x.blocksize, "maxblkid": x.maxblkid, "size": x.size, "used": x.used, "first_offset": x.blkptr[0].dva[0].offset, "bonus_len": len(x.bonus)}]

    rows = t(spark, d, "orders").select(c("o_orderkey").cast("long"), raw(*head, *first, zeros(320)))
    return decoded(rows, fn, "o_orderkey long, type long, blocksize long, maxblkid long, size long, used long, first_offset long, bonus_len long")


@query("""select o_orderkey, 5000 as version, o_orderkey + 4 as txg, o_custkey * 65537 as guid_sum, 1600000000 + o_orderkey as timestamp,
case when o_orderkey % 2 = 0 then 'little' else 'big' end as endian from orders""")
def q_decode_uberblock(spark, d):
    c = F.col
    words = [F.lit(0x00BAB10C), F.lit(5000), c("o_orderkey") + 4, c("o_custkey") * 65537, c("o_orderkey") + 1600000000]
    body = F.when(c("o_orderkey") % 2 == 0, F.concat(*(number(w) for w in words))).otherwise(F.concat(*(number(w, little=False) for w in words)))

    def fn(o_orderkey, raw):
        x = blocks.uberblock(raw)
        return [{"o_orderkey": o_orderkey, "version": x.version, "txg": x.txg, "guid_sum": x.guid_sum, "timestamp": x.timestamp, "endian": x.endian}]

    rows = t(spark, d, "orders").select(c("o_orderkey").cast("long"), raw(body, zeros(1024 - 40)))
    return decoded(rows, fn, "o_orderkey long, version long, txg long, guid_sum long, timestamp long, endian string")


@query("select c_custkey, c_custkey * 2049 % 281474976710656 as object, c_custkey % 16 as kind from customer")
def q_decode_dirent(spark, d):
    value = F.shiftleft(F.col("c_custkey").cast("long") % 16, 60) + F.col("c_custkey") * 2049

    def fn(c_custkey, raw):
        obj, kind = blocks.dirent(int.from_bytes(raw, "little"))
        return [{"c_custkey": c_custkey, "object": obj, "kind": kind}]

    return decoded(t(spark, d, "customer").select(F.col("c_custkey").cast("long"), raw(number(value))), fn, "c_custkey long, object long, kind long")


def _xdr(value: Column) -> Column:
    """An XDR string: its length, its bytes, and zeros up to a multiple of four."""
    n = F.octet_length(value)
    return F.concat(number(n, 4, False), F.rpad(F.hex(value.cast("binary")), (F.ceil(n / 4) * 8).cast("int"), "0"))


def _pair(name: str, kind: int, body: Column) -> Column:
    head = F.concat(_xdr(F.lit(name)), number(kind, 4, False), number(1, 4, False), body)
    size = number(F.length(head) / 2 + 8, 4, False)
    return F.concat(size, size, head)


@query("""select c_custkey, c_name as name, c_custkey * 3 as txg, c_nationkey as nation, 'name:9 txg:8 vdev:19' as shape from customer""")
def q_decode_nvlist(spark, d):
    start, stop = F.lit("0000000000000001"), zeros(8)
    inner = F.concat(start, _pair("nation", 8, number(F.col("c_nationkey"), 8, False)), stop)
    whole = [F.lit("01010000"), start, _pair("name", 9, _xdr(F.col("c_name"))), _pair("txg", 8, number(F.col("c_custkey") * 3, 8, False)), _pair("vdev", 19, inner), stop]

    def fn(c_custkey, raw):
        x = nvlist.parse(raw)
        shape = " ".join(f"{k}:{kind}" for k, (kind, _) in x.items())
        return [{"c_custkey": c_custkey, "name": nvlist.text(x, "name"), "txg": nvlist.u64(x, "txg"), "nation": nvlist.u64(nvlist.child(x, "vdev"), "nation"), "shape": shape}]

    return decoded(t(spark, d, "customer").select(F.col("c_custkey").cast("long"), raw(*whole)), fn, "c_custkey long, name string, txg long, nation long, shape string")


@query("""select s_suppkey, name, value, cd from (
select s_suppkey, s_name as name, s_suppkey * 11 as value, 0 as cd from supplier
union all select s_suppkey, 'nation', s_nationkey, s_suppkey % 3 from supplier)""")
def q_decode_micro_zap(spark, d):
    def entry(name: Column, value: Column, cd: Column) -> Column:
        return F.concat(number(value), number(cd, 4), zeros(2), F.rpad(F.hex(name.cast("binary")), 100, "0"))

    body = [F.lit("0300000000000080"), number(7), zeros(48), entry(F.col("s_name"), F.col("s_suppkey") * 11, F.lit(0)), zeros(64), entry(F.lit("nation"), F.col("s_nationkey"), F.col("s_suppkey") % 3)]

    def fn(s_suppkey, raw):
        if zap.kind(raw) != 0x8000000000000003:
            return []
        return [{"s_suppkey": s_suppkey, "name": e.name, "value": e.ints[0], "cd": e.cd} for e in zap.micro(raw)]

    return decoded(t(spark, d, "supplier").select(F.col("s_suppkey").cast("long"), raw(*body)), fn, "s_suppkey long, name string, value long, cd long")


@query("""select o_orderkey, seq, kind, log_offset, run, vdev from (
select o_orderkey, 0 as seq, case when o_orderkey % 2 = 1 then 'free' else 'alloc' end as kind, o_orderkey * 4096 as log_offset, (o_custkey % 32768 + 1) * 4096 as run, -1 as vdev from orders
union all select o_orderkey, 1, case when o_custkey % 2 = 1 then 'free' else 'alloc' end, o_custkey * 4096, (o_orderkey + 1) * 4096, o_custkey % 5 from orders)""")
def q_decode_space_log(spark, d):
    c = F.col
    one = F.shiftleft(c("o_orderkey").cast("long"), 16) + F.shiftleft(c("o_orderkey").cast("long") % 2, 15) + c("o_custkey") % 32768
    wide = [F.shiftleft(F.lit(3).cast("long"), 62) + F.shiftleft(c("o_orderkey").cast("long"), 24) + c("o_custkey") % 5, F.shiftleft(c("o_custkey").cast("long") % 2, 63) + c("o_custkey")]
    marker = F.shiftleft(F.lit(2).cast("long"), 62) + 77

    def fn(o_orderkey, raw):
        return [{"o_orderkey": o_orderkey, "seq": s.seq, "kind": s.kind, "log_offset": s.offset, "run": s.run, "vdev": -1 if s.vdev is None else s.vdev} for s in dsl.space_log(raw, 12)]

    rows = t(spark, d, "orders").select(c("o_orderkey").cast("long"), raw(number(marker), number(one), *(number(w) for w in wide)))
    return decoded(rows, fn, "o_orderkey long, seq long, kind string, log_offset long, run long, vdev long")


@query("""with p as (select unnest([0, 1, 2]) as i),
m as (select o_orderkey, i, i * 8192 as src, 8192 as size, (o_custkey + i) % 7 as vdev, (o_orderkey + i) * 512 as dst from orders, p),
r as (select o_orderkey, 4096 as a, 4096 + 8192 + o_custkey % 16 * 512 as b from orders)
select r.o_orderkey, vdev, dst + greatest(a, src) - src as dst_offset, least(b, src + size) - greatest(a, src) as n
from r join m on r.o_orderkey = m.o_orderkey and a < src + size and src < b""")
def q_decode_indirect(spark, d):
    """Entries are stored out of order; a read over two or three of them comes back in pieces."""
    c = F.col
    parts = [x for i in (2, 0, 1) for x in (number(16 * i), number(F.lit(16), 4), number((c("o_custkey") + i) % 7, 4), number(c("o_orderkey") + i))]

    def fn(o_orderkey, length, raw):
        return [{"o_orderkey": o_orderkey, "vdev": v, "dst_offset": at, "n": n} for v, at, n in dsl.indirect(raw, 3).remap(4096, length)]

    rows = t(spark, d, "orders").select(c("o_orderkey").cast("long"), (c("o_custkey") % 16 * 512 + 8192).cast("long").alias("length"), raw(*parts))
    return decoded(rows, fn, "o_orderkey long, vdev long, dst_offset long, n long")


@query("""select doc_id, sha256(coalesce(text, '')) as sha256, 'Ok' as right_one, 'Mismatch' as wrong_one, 'NotChecked' as none from documents""")
def q_decode_sha256_verdict(spark, d):
    def fn(doc_id, raw):
        words = checksums.sha256(raw)
        wrong = (*words[:3], words[3] ^ 1)
        return [{"doc_id": doc_id, "sha256": "".join(f"{w:016x}" for w in words), "right_one": checksums.verdict(8, raw, words), "wrong_one": checksums.verdict(8, raw, wrong), "none": checksums.verdict(2, raw, wrong)}]

    rows = t(spark, d, "documents").select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("raw"))
    return decoded(rows, fn, "doc_id long, sha256 string, right_one string, wrong_one string, none string")


@query("""select l_orderkey, l_linenumber, l_orderkey + l_partkey + l_suppkey + l_linenumber as a, 4 * l_orderkey + 3 * l_partkey + 2 * l_suppkey + l_linenumber as b,
10 * l_orderkey + 6 * l_partkey + 3 * l_suppkey + l_linenumber as c, 20 * l_orderkey + 10 * l_partkey + 4 * l_suppkey + l_linenumber as d,
l_orderkey + 4294967296 * l_partkey as e, l_suppkey + 4294967296 * l_linenumber as f from lineitem""")
def q_decode_fletcher_words(spark, d):
    c = F.col
    parts = [number(c(x), 4) for x in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]

    def fn(l_orderkey, l_linenumber, raw):
        four, two = checksums.fletcher4(raw), checksums.fletcher2(raw)
        return [{"l_orderkey": l_orderkey, "l_linenumber": l_linenumber} | dict(zip("abcdef", (*four, *two[:2]), strict=True))]

    rows = t(spark, d, "lineitem").select(c("l_orderkey").cast("long"), c("l_linenumber").cast("long"), raw(*parts))
    return decoded(rows, fn, "l_orderkey long, l_linenumber long, a long, b long, c long, d long, e long, f long")


_CODECS = ("lz4", "gzip-6", "zstd")


@query("""select doc_id, codec, octet_length(encode(coalesce(text, ''))) as size, sha256(coalesce(text, '')) as sha256
from documents, (select unnest(['lz4', 'gzip-6', 'zstd']) as codec) where coalesce(text, '') <> ''""")
def q_decode_codecs(spark, d):
    """Texts packed by the codecs' libraries and unpacked by the block decoders."""

    def fn(doc_id, codec, raw):
        n = len(raw)
        if codec == "lz4":
            body = pa.Codec("lz4_raw").compress(raw, asbytes=True)
            packed = len(body).to_bytes(4, "big") + body
        elif codec == "zstd":
            body = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(3, format=zstandard.FORMAT_ZSTD1_MAGICLESS)).compress(raw)
            packed = len(body).to_bytes(4, "big") + bytes(4) + body
        else:
            packed = zlib.compress(raw, 6)
        out = compress.decompress(compress.CODES[codec], packed + bytes(-len(packed) % 512), n)
        return [{"doc_id": doc_id, "codec": codec, "size": len(out), "sha256": "".join(f"{w:016x}" for w in checksums.sha256(out))}]

    texts = t(spark, d, "documents").filter("text <> ''").select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("raw"))
    rows = texts.select("doc_id", F.explode(F.array(*map(F.lit, _CODECS))).alias("codec"), "raw")
    return decoded(rows, fn, "doc_id long, codec string, size long, sha256 string")


@query("""with x as (select l_orderkey, l_linenumber, l_partkey * 4096 as off, (l_suppkey % 200 + 1) as sectors, 4 + l_linenumber as n, 1 + l_linenumber % 3 as p from lineitem),
y as (select *, off >> 12 as s, sectors // (n - p) as q, sectors % (n - p) as r from x),
z as (select *, case when r = 0 then 0 else r + p end as big from y),
c as (select *, unnest(range(case when q = 0 then big else n end)) as i from z),
w as (select *, case when p = 1 and (off // 1048576) % 2 = 1 and i < 2 then 1 - i else i end as place from c)
select l_orderkey, l_linenumber, place as col, (s % n + i) % n as child, ((s // n) << 12) + case when s % n + i >= n then 4096 else 0 end as col_offset,
(q + case when place < big then 1 else 0 end) << 12 as size from w""")
def q_decode_columns(spark, d):
    """Columns of striped blocks: where each begins, on which child, and how long it is."""
    c = F.col

    def fn(l_orderkey, l_linenumber, off, sectors):
        found = raidz.columns(off, sectors << 12, 12, 4 + l_linenumber, 1 + l_linenumber % 3)
        return [{"l_orderkey": l_orderkey, "l_linenumber": l_linenumber, "col": i, "child": x.child, "col_offset": x.offset, "size": x.size} for i, x in enumerate(found)]

    rows = t(spark, d, "lineitem").select(c("l_orderkey").cast("long"), c("l_linenumber").cast("long"), (c("l_partkey") * 4096).cast("long").alias("off"), (c("l_suppkey") % 200 + 1).cast("long").alias("sectors"))
    return decoded(rows, fn, "l_orderkey long, l_linenumber long, col long, child long, col_offset long, size long")


@query("""select l_orderkey, l_linenumber, l_orderkey as a, l_partkey as b, l_suppkey as c, l_linenumber as d, xor(xor(l_orderkey, l_partkey), xor(l_suppkey, l_linenumber)) as p from lineitem""")
def q_decode_rebuild(spark, d):
    """Four data words with three parities; as many words as there are parities, which ones by the row, are lost and solved."""
    c = F.col
    names = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")

    def fn(l_orderkey, l_linenumber, raw):
        data = [raw[i : i + 8] for i in range(0, 32, 8)]
        parity = raidz.generate(data, 3)
        lost = {(l_orderkey + i * (1 + l_linenumber % 3)) % 4 for i in range(1 + l_linenumber % 3)}
        kept = [None if i < 3 - len(lost) else x for i, x in enumerate(parity)]
        whole = raidz.reconstruct([None if i in lost else x for i, x in enumerate(data)], kept, [8] * 4)
        return [{"l_orderkey": l_orderkey, "l_linenumber": l_linenumber} | {k: int.from_bytes(x, "little") for k, x in zip("abcdp", (*whole, parity[0]), strict=True)}]

    rows = t(spark, d, "lineitem").select(c("l_orderkey").cast("long"), c("l_linenumber").cast("long"), raw(*(number(c(x)) for x in names)))
    return decoded(rows, fn, "l_orderkey long, l_linenumber long, a long, b long, c long, d long, p long")


def _doubled(x: str) -> str:
    return f"xor({x} * 2, case when {x} >= 128 then 285 else 0 end)"


@query(f"""with recursive x as (select i % 256 as a, i // 256 as b from range(65536) r(i)),
m as (select a, b, b as left_b, a as shifted, 0 as sum, 0 as k from x
union all select a, b, left_b // 2, {_doubled("shifted")}, xor(sum, case when left_b % 2 = 1 then shifted else 0 end), k + 1 from m where k < 8)
select a, b, sum as product, case when a > 0 then 1 else 0 end as inverts from m where k = 8""")
def q_decode_field(spark, d):
    """All products of the parity's field, by shifts and sums in SQL."""

    def fn(id):
        a, b = id % 256, id // 256
        return [{"a": a, "b": b, "product": raidz.multiply(a, b), "inverts": raidz.multiply(a, raidz.inverse(a)) if a else 0}]

    return decoded(spark.range(65536), fn, "a long, b long, product long, inverts long")


@query("""select p_partkey, (p_partkey % 1000 + 1) * 512 as part_offset, 5120 as length, '0x' || printf('%02x', p_size) as kind, p_size in (165, 191) as pool from part
union all select p_partkey, (p_partkey % 1000 + 2048) * 512, 10240, '0x' || printf('%02x', p_size + 141), p_size + 141 in (165, 191) from part""")
def q_decode_partitions(spark, d):
    """Two entries of a boot record's table for each row."""
    c = F.col

    def entry(kind: Column, first: Column, n: Column) -> Column:
        return F.concat(zeros(4), number(kind, 1), zeros(3), number(first, 4), number(n, 4))

    rows = t(spark, d, "part").select(c("p_partkey").cast("long"), raw(zeros(446), entry(c("p_size"), c("p_partkey") % 1000 + 1, F.lit(10)), entry(c("p_size") + 141, c("p_partkey") % 1000 + 2048, F.lit(20)), zeros(32), F.lit("55AA")))

    def fn(p_partkey, raw):
        return [{"p_partkey": p_partkey, "part_offset": x.start, "length": x.length, "kind": x.kind, "pool": x.pool} for x in media.mbr(raw)]

    return decoded(rows, fn, "p_partkey long, part_offset long, length long, kind string, pool boolean")
