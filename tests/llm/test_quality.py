import math
import zlib

import zstandard

from lodewell.llm import quality


def tables(spark, sf="sf0.01"):
    return (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    got = quality.digest(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95
    assert sum((r.score - r.quality) ** 2 for r in held) / len(held) < 0.05


def test_held_out_labels_do_not_matter(spark):
    from pyspark.sql import functions as F

    docs, labels = tables(spark, "sf0.001")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (sorted((r.doc_id, r.score) for r in quality.digest(docs, x).collect()) for x in (labels, flipped))
    assert one == two


def test_score_is_the_difference_alone(spark):
    """Every score against plain compression: each block with both dictionaries, one logistic of the difference."""
    docs, labels = tables(spark, "sf0.001")
    model = quality.train(docs, labels)
    plain = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
    good, bad = (zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), **plain) for d in (model.good, model.bad))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in quality.score(docs, model).collect():
        t, sizes = texts[r.doc_id], [0, 0]
        for at in range(0, len(t), quality.BLOCK):
            sizes[0] += len(good.compress(t[at : at + quality.BLOCK]))
            sizes[1] += len(bad.compress(t[at : at + quality.BLOCK]))
        x = (sizes[1] - sizes[0]) / len(t) if t else 0.0
        assert abs(r.score - 1 / (1 + math.exp(-(model.weights[0] + model.weights[1] * quality.SCALE * x)))) < 1e-9
    assert model.weights[1] > 0


def test_training_reads_whole_texts(spark):
    """Long labelled texts come whole; a text beyond the bound is passed over, the next ones are not."""
    rows = [(i, f"{i:05d} " * 20_000 if i % 4 else f"{i:05d}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    allowed = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    got = quality.sample(docs, labels).collect()
    assert sorted(r.text for r in got) == sorted(rows[i][1] for i in allowed)
    assert {r.part for r in got} == {0, 1} and all(r.quality == int(r.text[:5]) % 2 for r in got)
    bounded = quality.sample(docs, labels, sample_bytes=250_000).collect()
    for q in (0, 1):
        some = [r.text for r in bounded if r.quality == q]
        assert 120_000 <= sum(map(len, some)) <= 250_000 and all(t in (rows[int(t[:5])][1],) for t in some)
        assert q or sum(len(t) == 5 for t in some) == sum(i % 4 == 0 for i in allowed)


def test_odd_rows(spark, odd, clashing, empty):
    _, labels = tables(spark, "sf0.001")
    docs, _ = tables(spark, "sf0.001")
    model = quality.train(docs, labels)
    for df in (odd, clashing):
        got = quality.score(df, model).collect()
        assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)
        assert quality.keep_good(df, model).columns == df.columns
    by_text = {}
    for r, s in zip(odd.select("text").collect(), quality.score(odd, model).collect(), strict=True):
        assert by_text.setdefault(r.text or "", s.score) == s.score
    assert quality.score(empty, model).collect() == []
    assert quality.train(empty, labels) is None
    assert [r.score for r in quality.digest(odd, labels.limit(0)).collect()] == [0.5] * odd.count()
    assert quality.keep_good(odd, None).count() == odd.count()


def test_filter_keeps_what_scores_well(spark):
    docs, labels = tables(spark, "sf0.001")
    model = quality.train(docs, labels)
    assert model is not None
    kept = sorted(r.doc_id for r in quality.keep_good(docs, model).collect())
    assert kept == sorted(r.doc_id for r in quality.score(docs, model).filter("score >= 0.5").collect())


def test_odd_labels(spark):
    """Null ids, null and unknown labels, repeated rows and extra columns in the label table."""
    from pyspark.sql import functions as F

    docs, labels = tables(spark, "sf0.001")
    extra = spark.createDataFrame([(None, 1, 0), (5, None, None), (6, 7, 0)], labels.schema)
    odd_labels = labels.unionByName(extra).unionByName(labels.limit(10)).withColumn("text", F.lit("x")).withColumn("part", F.lit(9))
    model = quality.train(docs, odd_labels)
    assert model is not None and all(0 <= r.score <= 1 for r in quality.score(docs, model).collect())
