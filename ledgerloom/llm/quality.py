"""Quality by compression: dictionaries of good and of bad texts, and which of the two packs a text better."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches


class Training(NamedTuple):
    """texts: whole labelled texts of each label, of lowest hash, for its dictionary; calibration: further ones, of both
    labels as they come; size: bytes of a dictionary; piece: bytes compressed at a time; level: of the compressor."""

    texts: int = 400
    calibration: int = 1500
    size: int = 112_640
    piece: int = 1024
    level: int = 3


class Model(NamedTuple):
    good: bytes
    bad: bytes
    weights: np.ndarray


def _pieces(raw: bytes, size: int) -> list[bytes]:
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def build_dictionary(texts: list[str], t: Training) -> bytes:
    """A zstandard dictionary of the texts' pieces; of too few pieces to train one, their plain bytes."""
    samples = [p for x in texts for p in _pieces(x.encode(), t.piece)]
    try:
        return zstandard.train_dictionary(t.size, samples, level=t.level).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-t.size :]


class Sizes:
    """Compressed sizes of texts under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes, t: Training):
        self.piece = t.piece
        self.packers = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw) if raw else None
            if d:
                d.precompute_compress(level=t.level)
            self.packers.append(zstandard.ZstdCompressor(level=t.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def signals(self, text: str | None) -> tuple[float, float, float]:
        """The size difference as a share of both sizes; bytes saved by the better dictionary for each input byte; 1.

        The first is 0 for an empty text.
        """
        raw = (text or "").encode()
        if not raw:
            return 0.0, 0.0, 1.0
        pieces = _pieces(raw, self.piece)
        good, bad = (sum(len(c.compress(p)) for p in pieces) for c in self.packers)
        return (bad - good) / (bad + good), min(good, bad) / len(raw), 1.0


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(h, x.T @ (y - p) - ridge * w), -20, 20)
    return w


def expand(signals: np.ndarray) -> np.ndarray:
    """The calibrator's inputs: the difference, the packed share, their square terms and a constant."""
    d, s = signals[:, 0] * 10, signals[:, 1]
    return np.stack([d, d * np.abs(d), s, s * s, d * s, np.ones(len(d))], axis=1)


def fit(rows: list[tuple[str | None, int]], t: Training) -> Model:
    """rows (text, label 0 or 1), in hash order: the first of each label make its dictionary, the others calibrate."""
    used = {0: 0, 1: 0}
    texts: dict[int, list[str]] = {0: [], 1: []}
    rest = []
    n = {y: sum(1 for _, k in rows if k == y) for y in (0, 1)}
    for text, y in rows:
        if used[y] < min(t.texts, n[y] // 2):
            used[y] += 1
            texts[y].append(text or "")
        else:
            rest.append((text, y))
    good, bad = (build_dictionary(texts[y], t) for y in (1, 0))
    sizes = Sizes(good, bad, t)
    y = np.array([k for _, k in rest], dtype=float)
    if len(set(y)) < 2:
        constant = np.zeros(6)
        share = (n[1] + 1) / (n[0] + n[1] + 2)
        constant[-1] = np.log(share / (1 - share))
        return Model(good, bad, constant)
    # The dictionaries' share is taken from each label alike; weigh the rest back to the labels' own shares.
    x = expand(np.array([sizes.signals(text) for text, _ in rest]))
    w = calibrate(x, y)
    left = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    w[-1] += np.log(max(1, n[1]) / max(1, n[0])) - np.log(left[1] / left[0])
    return Model(good, bad, w)


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, t: Training) -> DataFrame:
    """(text, label, share) of bounded numbers of labelled rows, those of lowest hash (share).

    A doc_id of several labels counts with each. Bound: twice the texts + calibration rows of each label and a few more, of
    which ``fit`` takes the first.
    """
    most = t.texts + t.calibration
    marked = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    counts = marked.groupBy("label").count()
    share = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = marked.join(F.broadcast(counts), "label").withColumn("share", share).where(F.col("share") * F.col("count") <= 1.5 * most + 50)
    kept = few.orderBy("share", "doc_id", "label").limit(2 * (2 * most + 100))
    return docs.select("doc_id", "text").join(kept, "doc_id").orderBy("share", "doc_id", "label", "text").select("text", "label", "share").limit(4 * most + 200)


def learn(docs: DataFrame, labels: DataFrame, label: str, t: Training) -> Model:
    """A model fitted in one task on the bounded sample; the driver gets two dictionaries and six weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = {0: 0, 1: 0}, []
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[y] += 1
                if seen[y] <= t.texts + t.calibration:
                    rows.append((text, y))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows, t))], pa.binary())], ["model"])

    rows = sample_labelled(docs, labels, label, t).repartition(1).sortWithinPartitions("share", "label", "text")
    made = rows.mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0].model) if made else fit([], t)


def score_quality(docs: DataFrame, labels: DataFrame, learn_from: Column, label: str = "quality", training: Training = Training()) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, label) -> (doc_id, difference, score), one row for each row of docs.

    Dictionaries of good and bad whole texts are built from a bounded sample of the labelled rows where
    ``learn_from`` (a condition on doc_id) holds. Each whole text is compressed under both, piece by piece;
    the difference of the sizes, as a share of their sum, is calibrated to the probability of label 1. A null
    or empty text has difference 0 and the score that the calibrator gives to it. Without labels of both
    kinds the score is the labels' own share. Nothing else of a row is read; repeated rows score alike, very long texts
    are compressed whole, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    t = training
    model = learn(docs.where(learn_from), labels.where(learn_from), label, t)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        sizes = Sizes(model.good, model.bad, t)
        for batch in batches:
            signals = np.array([sizes.signals(x) for x in batch.column(1).to_pylist()]).reshape(-1, 3)
            score = 1 / (1 + np.exp(-np.clip(expand(signals) @ model.weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signals[:, 0]), pa.array(score)], ["doc_id", "difference", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, difference double, score double")
