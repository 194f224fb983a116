"""Quality classifier by compression against labelled text.

Two Zstandard dictionaries are trained, one on good and one on bad labelled
text. A document is compressed block by block with each; the difference of its
two sizes, normalised by its raw size, is the only input of the score: a
logistic calibration, fitted on other labelled rows, turns it into a
probability. (Sizes over the raw size, not over their own sum: a text that
compresses to nothing with either dictionary then differs by nothing, instead
of by the noise of a byte in twenty.)

Bounded parameters: of each label, up to ``sample_rows`` documents in the order
of an id hash, as long as their texts together have at most ``sample_bytes``
(a text that would go beyond is passed over); half of them for the
dictionaries, half for the calibration, always with their whole texts.
Everything scored is scored over its whole text.

Defined results: null and empty texts get the score of a zero difference; a
null doc_id is never a training row; without rows of both labels in both
halves every score is 0.5; labelled text too short or too uniform for
dictionary training serves as the dictionary's content itself; repeated rows
are scored one by one; further columns are ignored.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_bucket, id_text, map_batches, texts_of

SAMPLE_ROWS = 3000
SAMPLE_BYTES = 24 << 20
BLOCK = 1024
DICT_BYTES = 256 << 10
#: Training text for each byte of dictionary, at least.
TEXT_PER_BYTE = 4
LEVEL = 3
#: Differences are some thousandths of the raw size; this brings them to the calibration's unit.
SCALE = 50.0
FOLDS, HELD = 3, 1


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the calibration (intercept and slope); half a MB whatever the corpus."""

    good: bytes
    bad: bytes
    weights: tuple[float, float]


@functools.lru_cache(maxsize=4)
def _compressor(dictionary: bytes):
    """One compressor for each dictionary and worker process."""
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=False, write_content_size=False, write_dict_id=False)


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def difference(text: bytes, good, bad) -> float:
    """(size with the bad dictionary - size with the good one) / raw size."""
    if not text:
        return 0.0
    return sum(len(bad.compress(part)) - len(good.compress(part)) for part in blocks(text)) / len(text)


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Intercept and slope of the logistic regression of label ``y`` on difference ``x``."""
    a, w = np.column_stack([np.ones(len(x)), SCALE * x]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """The training rows (quality, part, text): part 0 is for the dictionaries, part 1 for the calibration."""
    allowed = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("quality")).filter("label_id is not null and quality in (0, 1)").filter(hash_bucket(F.col("label_id"), FOLDS) != HELD)
    order = F.xxhash64("label_id")
    picked = [allowed.filter(F.col("quality") == q).orderBy(order, "label_id").limit(sample_rows) for q in (0, 1)]
    own = id_text(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).filter("text is not null")
    first = F.broadcast(picked[0].unionByName(picked[1]).withColumn("part", F.pmod(order, F.lit(2)).cast("int")))  # 2 * sample_rows ids
    sizes = own.join(first, F.col("doc_id") == F.col("label_id")).groupBy("quality", "part", "label_id").agg(F.sum(F.octet_length("text")).alias("bytes"))
    chosen, spent = [], [0, 0]
    for r in sizes.orderBy(order, "label_id", "quality").collect():
        if spent[r["quality"]] + r["bytes"] <= sample_bytes:
            spent[r["quality"]] += r["bytes"]
            chosen.append((r["label_id"], r["quality"], r["part"]))
    ids = docs.sparkSession.createDataFrame(chosen, "label_id long, quality int, part int")
    return own.join(F.broadcast(ids), F.col("doc_id") == F.col("label_id")).select("quality", "part", "text")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Fit on rows outside the held-out fold; None without both labels."""
    rows = sample(docs, labels, sample_rows, sample_bytes)
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    for r in rows.filter("part = 0").select("quality", F.col("text").cast("binary").alias("text")).collect():  # sample_bytes a label
        texts[r["quality"]].append(bytes(r["text"]))
    if not all(any(side) for side in texts.values()):
        return None
    draft = Model(_dictionary(texts[1]), _dictionary(texts[0]), (0.0, 0.0))
    fitted = measure(rows.filter("part = 1").select(F.col("quality").cast("long").alias("doc_id"), "text"), draft).collect()
    y = np.array([r["doc_id"] for r in fitted], float)
    if len(set(y)) < 2:
        return None
    return Model(draft.good, draft.bad, calibrate(np.array([r["difference"] for r in fitted]), y))


def _dictionary(texts: list[bytes]) -> bytes:
    samples = sorted((b for t in texts for b in blocks(t)), key=lambda b: (len(b), b))
    size = min(DICT_BYTES, max(256, sum(map(len, samples)) // TEXT_PER_BYTE))
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little or too uniform text: it is the content itself, as the module says
        return b"".join(samples)[-DICT_BYTES:]


def measure(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, difference of every row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.good, model.bad))

    def fn(batch: pa.RecordBatch) -> dict:
        good, bad = _compressor(shared.value[0]), _compressor(shared.value[1])
        return {"doc_id": batch.column("doc_id"), "difference": [difference(t, good, bad) for t in texts_of(batch, "text")]}

    return map_batches(docs, fn, "doc_id long, difference double")


def probability(found: np.ndarray, weights: tuple[float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(weights[0] + weights[1] * SCALE * found, -30, 30)))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the calibrated score of every row."""
    own = id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    if model is None:
        return own.select("doc_id", F.lit(0.5).alias("score"))
    linear = F.lit(model.weights[0]) + F.lit(model.weights[1] * SCALE) * F.col("difference")
    return measure(own, model).select("doc_id", (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), linear))))).alias("score"))


def keep_good(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score ``threshold`` or more, columns unchanged."""
    if model is None:
        return docs
    spark, schema = docs.sparkSession, docs.schema
    shared = spark.sparkContext.broadcast(model)

    def fn(batch: pa.RecordBatch) -> dict:
        good, bad = _compressor(shared.value.good), _compressor(shared.value.bad)
        found = np.array([difference(t, good, bad) for t in texts_of(batch, text_col)], float)
        mask = pa.array(probability(found, shared.value.weights) >= threshold)
        return {f.name: batch.column(f.name).filter(mask) for f in schema}

    return map_batches(docs, fn, schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    found = score(docs, train(docs, labels))
    return found.select("doc_id", (hash_bucket(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
