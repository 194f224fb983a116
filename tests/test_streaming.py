import json

from pyspark.sql import functions as F

from lodewell.decode import carve
from lodewell.fixtures.builder import Builder, Item, Volume
from lodewell.plans import commands
from lodewell.sources import evidence
from lodewell.streaming import logs, surface, versions


def test_surface_stream_equals_the_batch(spark, tmp_path):
    b = Builder(str(tmp_path), "single", 1, size=8 << 20)
    b.commit(9, 10, {"": Item(1, None, 5), "v": Item(2, Volume(1 << 16, 8192, {0: b"x" * 8192}), 6)})
    paths = b.finish()
    profile = carve.Profile(type=23)
    for _ in range(2):
        q = surface.run(surface.hits(spark, paths, profile, ("lz4",), 1 << 20, batch=3), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(120)
        assert q.exception() is None
        q.stop()
    streamed = spark.read.parquet(str(tmp_path / "out")).filter("reason is null")
    batch = commands.carve_scan(spark, paths, profile, codecs=("lz4",), chunk=1 << 20)["candidates"]
    columns = ["member", "off", "slot", "found", "type", "blocksize", "score"]
    assert sorted(streamed.select(columns).collect()) == sorted(batch.select(columns).collect())


def test_log_stream(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    got = []

    def sink(df, batch):
        got.extend((r.tool, r.status, json.loads(r.result)["n"]) for r in df.collect())

    for k in range(2):
        evidence.append(str(folder / f"{k}.jsonl"), {"tool": f"t{k}", "version": "1", "argv": [], "inputs": [], "outputs": [], "result": {"n": k}, "status": 0})
        (folder / f"bad{k}.jsonl").write_text('{"v": 3}\nnothing\n')
        q = logs.follow(logs.records(spark, str(folder)), sink, str(tmp_path / "cp"))
        q.awaitTermination(120)
        q.stop()
    assert got == [("t0", 0, 0), ("t1", 0, 1)]


def test_version_stream(spark, tmp_path):
    source, rows = tmp_path / "in", [("p", 1, [1], ["p/a"]), ("p", 2, [1, 2], ["p/a", "p/b"]), ("p", 3, [2], ["p/c"]), ("q", 1, [9], ["q"])]
    schema = "pool string, txg long, guids array<long>, names array<string>"
    for k, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(source / str(k)))
        stream = spark.readStream.schema(schema).parquet(str(source / "*"))
        q = versions.events(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("txg", F.col("kind")).collect()
    assert [(r.txg, r.kind, r.name) for r in got] == [(2, "created", "p/b"), (3, "destroyed", "p/a"), (3, "renamed", "p/c")]
