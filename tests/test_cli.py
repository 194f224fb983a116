import hashlib
import json

import pytest

from lodewell import cli
from lodewell.plans.commands import EXIT
from tests.test_pool import history_pool, image_of  # noqa: F401


@pytest.fixture
def run(spark, capsys):
    def call(*argv):
        status = cli.main(["--json", *map(str, argv)], spark)
        return status, json.loads(capsys.readouterr().out)

    return call


def test_commands(run, history_pool, tmp_path):  # noqa: F811
    paths, vol, *_ = history_pool
    log, out = tmp_path / "case.jsonl", tmp_path / "vol.img"
    status, found = run("scan", *paths)
    assert status == EXIT["ok"] and found["pools"][0]["name"] == "tank"
    status, found = run("list", *paths, "--at", 101)
    assert status == EXIT["ok"] and {r["name"] for r in found["datasets"]} == {"tank", "tank/fs", "tank/vol"}
    status, found = run("timeline", *paths, "--from", 101, "--to", 102)
    assert status == EXIT["ok"] and {r["txg"] for r in found["events"]} <= {101, 102} and found["events"]
    status, found = run("--log", log, "dump", *paths, "--dataset", "tank/vol", "--at", 101, "--output", out, "--hash", "sha256")
    assert status == EXIT["ok"] and found["sha256"] == hashlib.sha256(image_of(vol)).hexdigest() and out.read_bytes() == image_of(vol)
    assert run("dump", *paths, "--dataset", "tank/vol", "--at", 101, "--output", paths[0])[0] == EXIT["refused"]
    assert run("dump", *paths, "--dataset", "tank/none", "--output", tmp_path / "x")[0] == EXIT["unreadable"]
    status, found = run("files", "list", *paths, "--dataset", "tank/fs", "--at", 100)
    assert status == EXIT["ok"] and "a/b.txt" in {r["path"] for r in found["entries"]}

    key, report = tmp_path / "key", tmp_path / "report.json"
    assert run("report", "keygen", "--output", key)[0] == EXIT["ok"]
    status, found = run("report", "build", log, "--case", "c1", "--examiner", "e", "--sign", key, "--output", report)
    assert status == EXIT["ok"] and found["case"] == "c1" and found["extractions"][0]["dataset"] == "tank/vol" and "case: c1" in report.with_suffix(".md").read_text()
    status, found = run("report", "verify", log, "--report", report, "--public", f"{key}.pub")
    assert status == EXIT["ok"] and found["signature"] == "PASS" and {r["status"] for r in found["files"]} == {"PASS"}
    report.write_text(report.read_text().replace("c1", "c2"))
    out.write_bytes(b"changed")
    status, found = run("report", "verify", log, "--report", report, "--public", f"{key}.pub")
    assert status == EXIT["partial"] and found["signature"] == "FAIL" and "FAIL" in {r["status"] for r in found["files"]}


def test_carve_and_its_index(run, history_pool, tmp_path):  # noqa: F811
    paths, *_ = history_pool
    index = tmp_path / "hits.jsonl"
    status, found = run("carve", "scan", paths[0], "--range", "0:", "--codec", "lz4", "--max-hits", 20, "--index", index)
    assert status == EXIT["ok"] and 0 < len(found["candidates"]) <= 20
    status, listed = run("carve", "list", index, "--id", found["candidates"][0]["id"])
    assert status == EXIT["ok"] and [r["id"] for r in listed["candidates"]] == [found["candidates"][0]["id"]]
    assert run("carve", "list", index, "--id", "c9999")[0] == EXIT["unreadable"]


def test_usage(spark, capsys):
    assert cli.main(["scan"], spark) == EXIT["usage"] and cli.main([], spark) == EXIT["usage"] and cli.main(["--help"], spark) == EXIT["ok"]
    assert [cli.span(x) for x in ("5:9", "7", "0x10:", ":3")] == [(5, 9), (7, 7), (16, (1 << 63) - 1), (0, 3)]
    assert cli.show({"a": 1, "rows": [{"x": "\x1b[2J", "y": None}]}) == "a: 1\nrows:\n  x\ty\n  \\u001b[2J\t-"
