"""Operator 2, quality classifier: two zstandard dictionaries, of good and of bad labelled text.

A text is cut into blocks that are compressed on their own with either dictionary, so the
dictionary, not the text before, decides the size. The size with the bad one less the size with
the good one, for each byte of text, becomes a probability by logistic calibration on labelled
rows that the dictionaries haven't seen.

Fitting reads a bounded sample: at most sample_per_class labelled documents of each class, in the order
of a hash of their id, of texts of at most sample_bytes bytes and total_bytes bytes a class together. Scoring reads every whole text.

Cases: null or empty text has difference 0 and so one fixed score; a very long text is scored block by block, so
only the text itself is held; labels other than 0 and 1, null
ids and ids with both labels are not learned from, and a repeated id counts once; with one class alone or no labels every score is the
smoothed share of label 1; ties and repeated rows are scored alike; an empty table gives an empty
result; columns of the input are carried under their names, except score and predicted, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surfacelab.llm.shared import column, labelled_sample, others, plain, renamed, table

SAMPLE_PER_CLASS, SAMPLE_BYTES, TOTAL_BYTES = 1500, 200_000, 24_000_000
DICTIONARY_BYTES, BLOCK_BYTES, LEVEL = 112_640, 1024, 3


@dataclass(frozen=True)
class Model:
    good: bytes | None
    bad: bytes | None
    slope: float
    intercept: float


def _blocks(text: str | None) -> list[bytes]:
    data = (text or "").encode()
    return [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]


def _dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; of few samples a smaller one, and of very few the text itself."""
    samples = [b for t in texts for b in _blocks(t)]
    total = sum(map(len, samples))
    for size in (DICTIONARY_BYTES, total // 10, total // 40):
        try:
            if 256 <= size <= DICTIONARY_BYTES and size * 4 <= total:
                return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:
            continue
    return b"".join(samples)[-DICTIONARY_BYTES:]


class Scorer:
    """Compressors of a model, made once in a task."""

    def __init__(self, model: Model):
        self.model, self.sizes = model, None
        if model.good and model.bad:
            dicts = [zstandard.ZstdCompressionDict(d) for d in (model.good, model.bad)]
            for d in dicts:
                d.precompute_compress(level=LEVEL)
            self.sizes = [zstandard.ZstdCompressor(level=LEVEL, dict_data=d) for d in dicts]

    def difference(self, text: str | None) -> float:
        if self.sizes is None or not text:
            return 0.0
        good, bad = self.sizes
        blocks = _blocks(text)
        return (sum(len(bad.compress(b)) for b in blocks) - sum(len(good.compress(b)) for b in blocks)) / sum(map(len, blocks))

    def score(self, differences: np.ndarray) -> np.ndarray:
        z = self.model.slope * differences + self.model.intercept
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept of a logistic curve by Newton's method."""
    scale = float(np.std(x)) or 1.0
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(2), a.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
    return float(w[0] / scale), float(w[1])


def train(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS, sample_bytes: int = SAMPLE_BYTES, total_bytes: int = TOTAL_BYTES) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, label)."""
    got: dict[int, list[str]] = {0: [], 1: []}
    for label, text in labelled_sample(docs, labels.where("label IN (0, 1)"), sample_per_class, sample_bytes, total_bytes):
        if text:
            got[label].append(text)
    n = {k: len(v) for k, v in got.items()}
    if min(n.values()) < 3:
        share = (n[1] + 1) / (n[0] + n[1] + 2)
        return Model(None, None, 0.0, float(np.log(share / (1 - share))))
    # Two of three rows make the dictionaries; every third is kept for the calibration.
    model = Model(*(_dictionary([t for i, t in enumerate(got[k]) if i % 3]) for k in (1, 0)), 1.0, 0.0)
    scorer = Scorer(model)
    x, y = zip(*((scorer.difference(t), k) for k in (0, 1) for t in got[k][::3]))
    return Model(model.good, model.bad, *calibrate(np.array(x), np.array(y, float)))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs with score (probability of label 1) and predicted."""
    carried = others(docs, ("score", "predicted"))
    rows, names = plain(docs, carried, text=column(text).cast("string"))

    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            d = np.array([scorer.difference(t.as_py()) for t in b.column(b.num_columns - 1)], float)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scorer.score(d))], [*names, "score"])

    schema = rows.drop("text").schema.add("score", T.DoubleType())
    return renamed(rows.mapInArrow(run, schema), carried).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(parts: int, which: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts == which


def learnable_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, label of the documents that may be learned from."""
    labels = table(spark, sf_dir, "labels").where("quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("most"))
    return labels.where(F.col("label") == F.col("most")).where(~held_out(4, 2)).select("doc_id", "label")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, learnable_labels(spark, sf_dir))
    return score(docs, model).withColumn("held_out", held_out(4, 2)).select("doc_id", "held_out", "score", "predicted")
