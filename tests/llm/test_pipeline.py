import corpus_pipeline
from lodewell.llm import decontaminate, linededup, packing, quality
from lodewell.runtime import write_table
from tests.llm.test_linededup import slow as slow_lines
from tests.llm.test_neardup import slow_groups

SF = "/root/testdata/sf0.001"


def test_stages_against_their_own_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        docs = write_table(stage(spark, docs, SF), f"test-{name}").df
        out[name] = (before, [r.asDict() for r in docs.collect()])
        if name != "packing":
            assert docs.columns == columns
    before, after = out["quality"]
    frame = spark.createDataFrame(before, spark.read.parquet(f"{SF}/documents.parquet").schema)
    model = quality.train(frame, spark.read.parquet(f"{SF}/labels.parquet"))
    assert sorted(r["doc_id"] for r in after) == sorted(r.doc_id for r in quality.score(frame, model).filter("score >= 0.5").collect())
    before, after = out["line_dedup"]
    want = [(d, t) for d, t in slow_lines([(r["doc_id"], r["source"], r["text"]) for r in before], linededup.SITES) if t.strip()]
    assert sorted((r["doc_id"], r["text"]) for r in after) == sorted(want)
    before, after = out["near_dedup"]
    assert sorted(r["doc_id"] for r in after) == sorted(set(slow_groups([(r["doc_id"], r["text"]) for r in before]).values()))
    before, after = out["decontaminate"]
    items = [(str(r.item_id), r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = decontaminate.WindowSet(items)
    clean = {r["doc_id"]: r["text"] for r in before if not windows.scan(r["text"].encode())[1]}
    kept = {r["doc_id"]: r["text"] for r in after}
    assert len(clean) < len(before)
    assert clean.items() <= kept.items() and not any(windows.scan(t.encode())[1] for t in kept.values())
    before, after = out["packing"]
    assert sum(r["length"] for r in after) == sum(len(packing.token_ids(r["text"], packing.vocabulary_path())) for r in before)


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = write_table(stage(spark, docs, SF), f"test-{name}").df
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(corpus_pipeline.run(spark, SF).select(*keys).collect()) == sorted(docs.select(*keys).collect())


def test_odd_tables(spark, odd, clashing, empty):
    """Nulls, blanks, repeats, clashing columns and no rows at all go through every stage."""
    for df in (odd, clashing, empty):
        docs, before = df, df.count()
        for name, stage in corpus_pipeline.STAGES:
            docs = write_table(stage(spark, docs, SF), f"test-odd-{name}").df
            if name != "packing":
                assert docs.columns == df.columns and docs.count() <= before
                before = docs.count()
        assert docs.select("doc_id").distinct().count() <= before and (docs.count() > 0) == (before > 0)


def test_run_on_odd_documents(spark, odd, tmp_path):
    """The whole run over a folder whose documents are the odd rows, twice, without one usable label."""
    odd.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, 1, 0), (4, None, 0), (99, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, "no id at all here"), ("x", None), ("y", "")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and {r.doc_id for r in rows} <= {None, *range(1, 10)}
    lengths = {}
    for r in rows:
        lengths.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in x) <= 1024 and sorted(x)[0][0] == 0 for x in lengths.values())
