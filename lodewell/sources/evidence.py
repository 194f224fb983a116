"""Evidence logs: one JSON record per run, appended and never rewritten."""

from __future__ import annotations

import hashlib
import json
import os
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
_FILE = "struct<path:string,kind:string,size:bigint,sha256:string,sha1:string,md5:string>"
RECORD = f"v int, ts bigint, tool string, version string, host string, cwd string, argv array<string>, inputs array<{_FILE}>, outputs array<{_FILE}>, status int"


def append(path: str, record: dict[str, Any]) -> None:
    """One record, one write, at the end of the file."""
    line = json.dumps({"v": VERSION, "ts": int(time.time())} | record, ensure_ascii=False) + "\n"
    fd = os.open(path, os.O_WRONLY | os.O_APPEND | os.O_CREAT, 0o644)
    try:
        os.write(fd, line.encode())
    finally:
        os.close(fd)


def describe(path: str, hashes: tuple[str, ...] = ("sha256",)) -> dict[str, Any]:
    """A file as a record lists it; devices are never hashed."""
    from ..pool.members import kind_of

    kind = kind_of(path)
    out: dict[str, Any] = {"path": path, "kind": kind, "size": os.path.getsize(path) if kind == "file" else 0}
    if kind == "file":
        found = {h: hashlib.new(h) for h in hashes}
        with open(path, "rb") as f:
            while part := f.read(1 << 20):
                for h in found.values():
                    h.update(part)
        out |= {k: h.hexdigest() for k, h in found.items()}
    return out


def read_logs(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records, rejected lines). Records carry log, line, the record's text and its result as JSON.

    A line that is no JSON object is left out by number; a record of another
    version is refused where it is read.
    """
    from functools import reduce

    frames = []
    for i, p in enumerate(paths):  # a log's lines are numbered in the file's order, so each file is read as one
        numbered = spark.read.text(p, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "text"))
        frames.append(numbered.select(F.lit(i).alias("log"), (F.col("line") + 1).alias("line"), "text").filter(F.trim("text") != ""))
    lines = reduce(DataFrame.unionByName, frames)
    parsed = lines.withColumn("r", F.from_json("text", RECORD, {"mode": "PERMISSIVE"})).withColumn("_json", F.try_parse_json("text"))
    ok = F.col("_json").isNotNull() & F.col("text").rlike(r"^\s*\{")
    rejected = parsed.filter(~ok).select("log", "line")
    bad = F.raise_error(F.format_string("log %d line %d: record version is not %d", F.col("log"), F.col("line"), F.lit(VERSION)))
    records = parsed.filter(ok).select("log", "line", "text", F.when(F.col("r.v") == VERSION, F.col("r.v")).otherwise(bad).alias("v"), *(F.col("r")[c].alias(c) for c in ("ts", "tool", "version", "host", "cwd", "argv", "inputs", "outputs", "status")), F.get_json_object("text", "$.result").alias("result"))
    return records, rejected
