"""The command line: scan, list, timeline, dump, carve, files and report over pool members, as text or JSON.

    python -m lodewell scan disk0.img disk1.img
    python -m lodewell --json list disk*.img --at 100
    python -m lodewell --log case.jsonl dump disk*.img --dataset tank/vol --output vol.img --hash sha256

The exit status is the command's (see ``commands.EXIT``). With ``--log`` each
run appends a record of its inputs, outputs, status and result, which
``report build`` reads.
"""

from __future__ import annotations

import argparse
import json
import os
import platform
import sys
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from . import __version__
from .decode import Damage, carve, media
from .functions import sign
from .plans import commands
from .plans.commands import EXIT
from .pool import assemble, layout
from .sources import evidence, image

CODECS = ("lz4", "lzjb", "gzip", "zstd")


def span(text: str) -> tuple[int, int]:
    """``a:b``, either end may be missing; a single number is both."""
    first, colon, last = text.partition(":")
    return int(first or "0", 0), int(last, 0) if last else (1 << 63) - 1 if colon else int(first, 0)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodewell", description=__doc__.split("\n")[0])
    top.add_argument("--json", action="store_true", help="one JSON document instead of text")
    top.add_argument("--log", metavar="FILE", help="append a record of this run")
    top.add_argument("--master", default="local[*]", help="Spark master, if no session is running")
    sub = top.add_subparsers(dest="command", required=True)

    def command(parent, name: str, run: Callable, *, pool: bool = False, members: bool = True) -> argparse.ArgumentParser:
        p = parent.add_parser(name, help=(run.__doc__ or "").split("\n")[0])
        p.set_defaults(run=run)
        if members:
            p.add_argument("members", nargs="+", help="member devices or images")
            p.add_argument("--map", action="append", default=[], metavar="N=FILE", help="imager map of member N: its unread ranges are refused")
        if pool:
            p.add_argument("--pool", type=lambda x: int(x, 0), metavar="GUID", help="which pool, if the members hold several")
        return p

    p = command(sub, "scan", scan)
    p.add_argument("--emit-label", metavar="FILE", help="write the first label, rebuilt from the first member's config")
    p = command(sub, "list", list_, pool=True)
    p.add_argument("--at", type=int, metavar="TXG")
    p.add_argument("--before", type=int, metavar="SECONDS")
    p.add_argument("--diff", action="store_true")
    p.add_argument("--properties", action="store_true")
    p = command(sub, "timeline", timeline, pool=True)
    p.add_argument("--from", dest="from_", type=int, metavar="TXG")
    p.add_argument("--to", type=int, metavar="TXG")
    p.add_argument("--dataset")
    p.add_argument("--pending", action="store_true")
    p = command(sub, "dump", dump, pool=True)
    p.add_argument("--dataset", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--at", type=int, metavar="TXG")
    p.add_argument("--recursive", "-r", action="store_true", help="every volume below, into the folder")
    p.add_argument("--resume", action="store_true")
    p.add_argument("--strict", action="store_true")
    p.add_argument("--hash", action="append", choices=("md5", "sha1", "sha256"))
    p.add_argument("--key", metavar="SPEC")

    carving = sub.add_parser("carve", help="what the surface still holds").add_subparsers(dest="what", required=True)
    p = command(carving, "scan", carve_scan)
    for name in ("--type", "--volblocksize", "--levels"):
        p.add_argument(name, type=lambda x: int(x, 0))
    p.add_argument("--txg", type=span, metavar="A:B")
    p.add_argument("--size", type=span, metavar="A:B")
    p.add_argument("--range", type=span, metavar="A:B", help="only candidates that start there")
    p.add_argument("--strict", action="store_true")
    p.add_argument("--codec", action="append", choices=CODECS, default=[])
    p.add_argument("--max-hits", type=int, default=10_000, help="candidates listed; the rest are counted")
    p.add_argument("--index", metavar="FILE", help="save the candidates for carve list")
    p = command(carving, "list", carve_list, members=False)
    p.add_argument("index")
    p.add_argument("--id")
    p = command(carving, "roots", carve_roots, pool=True)
    p.add_argument("--codec", action="append", choices=CODECS, default=[])
    p = command(carving, "zeropoint", zeropoint)
    p.add_argument("--least", type=int, default=1)

    files = sub.add_parser("files", help="the files of a file system").add_subparsers(dest="what", required=True)
    for name, run in (("list", files_list), ("extract", files_extract), ("objects", files_objects)):
        p = command(files, name, run, pool=True)
        p.add_argument("--dataset", required=True)
        p.add_argument("--at", type=int, metavar="TXG")
        if name != "objects":
            p.add_argument("--key", metavar="SPEC")
        if name == "list":
            p.add_argument("--path", default="")
        if name == "extract":
            p.add_argument("--output", required=True)

    report = sub.add_parser("report", help="the record of a case").add_subparsers(dest="what", required=True)
    p = command(report, "build", report_build, members=False)
    p.add_argument("logs", nargs="+")
    for name in ("case", "examiner", "note"):
        p.add_argument(f"--{name}")
    p.add_argument("--sign", metavar="FILE", help="private key to sign the report with")
    p.add_argument("--output", metavar="FILE", help="the report as JSON; Markdown lies beside it")
    p = command(report, "verify", report_verify, members=False)
    p.add_argument("logs", nargs="+")
    p.add_argument("--outputs-root", metavar="FOLDER")
    p.add_argument("--report", metavar="FILE", help="a signed report to check, too")
    p.add_argument("--public", metavar="FILE")
    p = command(report, "keygen", keygen, members=False)
    p.add_argument("--output", required=True, help="the private key; the public one lies beside it")
    return top


# Each command gives (tables and facts to show, status).


def _scanned(spark: SparkSession, args) -> commands.Scanned:
    refused = {}
    for entry in args.map:
        n, _, path = entry.partition("=")
        refused[int(n)] = media.refused(media.imager_map(Path(path).read_text()))
    return commands.scan(spark, args.members, refused or None)


def _pool(spark: SparkSession, args) -> tuple[commands.Scanned, assemble.Assembly]:
    found = _scanned(spark, args)
    return found, assemble.choose(found.pools, args.pool)


def scan(spark, args):
    """Labels, root pointers, device trees and pools of the members."""
    found = _scanned(spark, args)
    if args.emit_label:
        image.guard(args.emit_label, args.members)
        first = next(d for d in found.devices if d.config)
        Path(args.emit_label).write_bytes(layout.label_front(first.config, 0, os.path.getsize(first.path)))
    status = "ok" if found.pools and all(p.readable() for p in found.pools) else "unreadable" if not found.pools else "unrecoverable"
    return found.tables, EXIT[status]


def list_(spark, args):
    """The datasets at a version."""
    found, pool = _pool(spark, args)
    return {"datasets": commands.list_datasets(spark, found, pool, args.at, args.before, args.diff, properties=args.properties)}, EXIT["ok"]


def timeline(spark, args):
    """What changed between versions."""
    found, pool = _pool(spark, args)
    return {"events": commands.timeline(spark, found, pool, args.from_, args.to, args.dataset, args.pending)}, EXIT["ok"]


def dump(spark, args):
    """A volume, or every volume below a name, as sparse images."""
    found, pool = _pool(spark, args)
    if args.recursive:
        out = commands.dump_all(spark, found, pool, args.dataset, args.output, args.at)
    elif args.resume:
        out = commands.dump_resumable(spark, found, pool, args.dataset, args.output, args.at)
    else:
        out = commands.dump(spark, found, pool, args.dataset, args.output, args.at, args.strict, tuple(args.hash or ["sha256"]), args.key)
    return out, out["status"]


def carve_scan(spark, args):
    """Objects recognised on the surface, whatever points at them."""
    want = carve.Profile(args.type, args.volblocksize, args.levels, args.txg, args.size)
    out = commands.carve_scan(spark, args.members, want, args.strict, tuple(args.codec), max_hits=args.max_hits)
    if args.range:
        out["candidates"] = out["candidates"].filter(out["candidates"]["off"].between(*args.range))
    if args.index:
        image.guard(args.index, args.members)
        Path(args.index).write_text("".join(json.dumps(r.asDict(True), default=str) + "\n" for r in out["candidates"].collect()))  # --max-hits rows
    return out, EXIT["ok"]


def carve_list(spark, args):
    """The candidates of a saved index."""
    rows = [json.loads(x) for x in Path(args.index).read_text().splitlines()]
    rows = [r for r in rows if args.id in (None, r["id"])]
    return {"candidates": rows}, EXIT["ok"] if rows else EXIT["unreadable"]


def carve_roots(spark, args):
    """Meta object sets that no label leads to."""
    _, pool = _pool(spark, args)
    return {"roots": commands.carve_roots(spark, pool, tuple(args.codec))}, EXIT["ok"]


def zeropoint(spark, args):
    """Where members begin, by the root pointers that hold there."""
    return {"bases": commands.zero_points(spark, args.members, least=args.least)}, EXIT["ok"]


def files_list(spark, args):
    """Entries of a file system, depth first."""
    found, pool = _pool(spark, args)
    return {"entries": commands.list_files(found, pool, spark, args.dataset, args.path, txg=args.at, key=args.key)}, EXIT["ok"]


def files_extract(spark, args):
    """A file system's tree under a new folder."""
    found, pool = _pool(spark, args)
    rows = commands.extract_files(found, pool, spark, args.dataset, args.output, args.at, args.key).collect()
    lost = any(r["write_error"] or r["error"] for r in rows)
    return {"entries": [r.asDict(True) for r in rows]}, EXIT["partial" if lost else "ok"]


def files_objects(spark, args):
    """Every object of a dataset with the digest of its contents."""
    found, pool = _pool(spark, args)
    return {"objects": commands.list_objects(found, pool, spark, args.dataset, args.at)}, EXIT["ok"]


def report_build(spark, args):
    """The consolidated sections of run logs."""
    sections = commands.report_build(spark, args.logs)
    facts = {k: v for k, v in (("case", args.case), ("examiner", args.examiner), ("note", args.note)) if v}
    out = facts | {k: _plain(v) for k, v in sections.items()}
    if args.sign:
        secret = sign.from_pem("PRIVATE KEY", Path(args.sign).read_text())
        out["signature"] = {"public": sign.public_key(secret).hex(), "signature": sign.sign(secret, _canonical(out)).hex()}
    if args.output:
        image.guard(args.output, args.logs)
        Path(args.output).write_text(json.dumps(out, indent=1, default=str) + "\n")
        heading = "".join(f"* {k}: {v}\n" for k, v in facts.items())
        Path(args.output).with_suffix(".md").write_text(f"# Report\n\n{heading}\n{commands.markdown(sections)}")
    return out, EXIT["ok"]


def report_verify(spark, args):
    """Every recorded file against the file on disk now, and a report's signature."""
    rows = _plain(commands.report_verify(spark, commands.report_build(spark, args.logs), args.outputs_root))
    out: dict[str, Any] = {"files": rows}
    if args.report:
        signed = json.loads(Path(args.report).read_text())
        given = signed.pop("signature", {})
        public = sign.from_pem("PUBLIC KEY", Path(args.public).read_text()) if args.public else bytes.fromhex(given.get("public", ""))
        out["signature"] = "PASS" if sign.verify(public, _canonical(signed), bytes.fromhex(given.get("signature", ""))) else "FAIL"
    bad = out.get("signature") == "FAIL" or any(r["status"] in ("FAIL", "MISSING") for r in rows)
    return out, EXIT["partial" if bad else "ok"]


def keygen(spark, args):
    """A new pair of keys for report signatures."""
    secret, public = sign.generate()
    for path, kind, raw, mode in ((args.output, "PRIVATE KEY", secret, 0o600), (args.output + ".pub", "PUBLIC KEY", public, 0o644)):
        with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, mode), "w") as f:
            f.write(sign.to_pem(kind, raw))
    return {"public": public.hex()}, EXIT["ok"]


def _canonical(out: dict) -> bytes:
    return json.dumps(out, sort_keys=True, separators=(",", ":"), default=str).encode()


def _plain(value: Any) -> Any:
    return [r.asDict(True) for r in value.collect()] if isinstance(value, DataFrame) else value


def show(out: dict[str, Any]) -> str:
    """Facts as lines, tables under their names; nothing from the evidence steers the terminal."""
    lines = []

    def safe(v: Any) -> str:
        return "-" if v is None else "".join(c if c.isprintable() else f"\\u{ord(c):04x}" for c in str(v))

    for name, value in out.items():
        if isinstance(value, list) and value and isinstance(value[0], dict):
            lines += [f"{name}:", "  " + "\t".join(value[0])] + ["  " + "\t".join(map(safe, r.values())) for r in value]
        else:
            lines.append(f"{name}: {safe(value) if not isinstance(value, list) else len(value)}")
    return "\n".join(lines)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return EXIT["ok"] if e.code in (0, None) else EXIT["usage"]
    given = spark or SparkSession.builder.master(args.master).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    out: dict[str, Any]
    try:
        found, status = args.run(given, args)
        out = {k: _plain(v) for k, v in found.items()}
    except image.Overlap as e:
        out, status = {"error": str(e)}, EXIT["refused"]
    except (Damage, OSError) as e:
        out, status = {"error": str(e)}, EXIT["unreadable"]
    except ValueError as e:
        out, status = {"error": str(e)}, EXIT["usage"]
    except KeyboardInterrupt:
        out, status = {"error": "interrupted"}, EXIT["interrupted"]
    print(json.dumps(out, default=str) if args.json else show(out))
    if args.log:
        target = getattr(args, "output", None)
        outputs = [evidence.describe(target)] if target and os.path.isfile(target) else []
        facts = {k: v for k, v in out.items() if not isinstance(v, list)}
        evidence.append(args.log, {"tool": f"lodewell {args.command}", "version": __version__, "host": platform.node(), "cwd": os.getcwd(), "argv": list(argv if argv is not None else sys.argv[1:]), "inputs": [evidence.describe(p) for p in getattr(args, "members", [])], "outputs": outputs, "status": status, "result": facts})
    return status
