"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import aside, remainder, slices, with_fields

#: Weights of the model: a power of two.
SLOTS = 1 << 18
#: Labelled rows that a model is fitted on at most, the first by a hash of doc_id.
TRAINING_ROWS = 16_000
#: Models that are trained side by side, each on its share of the rows, and then averaged.
SHARES = 8
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
#: Hashes of tokens that a task remembers.
REMEMBERED = 1 << 17
#: Stands for any word that follows itself.
REPEAT = xxhash.xxh3_64_intdigest("\0repeat") >> 2


class Features:
    """Hashed unigrams and bigrams of words, numbers and runs of marks; words of capitals are words of their own, and a bigram of one word twice counts as such besides."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def _new(self, token: str) -> int:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        shape = "\0upper" if len(token) > 1 and token.isupper() else ""
        out = self.known[token] = xxhash.xxh3_64_intdigest(token.lower() + shape) >> 2
        return out

    def of(self, text: str | None) -> np.ndarray:
        """Slots of all n-grams of a text, repeated as often as they occur."""
        known, new = self.known, self._new
        tokens = TOKEN.findall(text or "")
        one = np.array([known[t] if t in known else new(t) for t in tokens], np.uint64)
        if not one.size:
            return one.astype(np.int64)
        again = np.full(int((one[:-1] == one[1:]).sum()), REPEAT, np.uint64)
        two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20)
        return (np.concatenate([one, two, again]) & np.uint64(SLOTS - 1)).astype(np.int64)


def dot(weights: np.ndarray, slots: np.ndarray) -> float:
    """Sparse dot product of a text's vector, of length 1 over the root of its number of n-grams, and the weights (bias last)."""
    return float(weights[slots].sum() / np.sqrt(len(slots)) + weights[-1]) if len(slots) else float(weights[-1])


def ftrl(examples: list[tuple[np.ndarray, int]], alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 3) -> np.ndarray:
    """Weights (bias last) by per-coordinate follow-the-regularised-leader updates, example by example."""
    z, n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
    prepared = []
    for slots, y in examples:
        at, counts = np.unique(slots, return_counts=True)
        prepared.append((np.append(at, SLOTS), np.append(counts / np.sqrt(max(1, len(slots))), 1.0), y))

    def weights(at):
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for at, x, y in prepared:
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(slice(None))


def _train(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features, rows = Features(), []
    for part in slices(batches, "text"):
        rows += zip(part.column("_order").to_pylist(), part.column("label").to_pylist(), map(features.of, part.column("text").to_pylist()), strict=True)
    rows.sort(key=lambda r: r[0])
    w = ftrl([(slots, y) for _, y, slots in rows])
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([w[at].astype("<f8").tobytes()], pa.binary())], ["n", "at", "weight"])


def train_quality(labelled: DataFrame, rows: int = TRAINING_ROWS) -> np.ndarray:
    """The model of a table of doc_id, text and label (0 or 1; other values are left out): SLOTS weights and a bias.

    At most `rows` rows are used, the first by a hash of doc_id. SHARES models are trained on groups of these and averaged by
    their rows; each group is bounded by `rows`. Without any labels the model is all zeros and scores one half.
    """
    order = F.xxhash64("doc_id")
    ids = labelled.where(F.col("label").isin(0, 1)).select("doc_id").orderBy(order, "doc_id").limit(rows)
    chosen = labelled.where(F.col("label").isin(0, 1)).join(F.broadcast(ids.distinct()), "doc_id", "left_semi").select(F.pmod(F.hash("doc_id"), F.lit(SHARES)).alias("_share"), order.alias("_order"), F.col("label").cast("int").alias("label"), "text")
    total, out = 0, np.zeros(SLOTS + 1)
    for r in chosen.groupBy("_share").applyInArrow(_train, "n long, at binary, weight binary").collect():
        out[np.frombuffer(r["at"], "<i4")] += np.frombuffer(r["weight"], "<f8") * r["n"]
        total += r["n"]
    return out / max(1, total)


def _score(shared, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, features = np.frombuffer(shared.value, "<f8"), Features()
        for part in slices(batches, "text"):
            scores = [1 / (1 + np.exp(-dot(weights, features.of(t)))) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(scores, pa.float64())], [*columns, "score"])

    return run


def score_quality(documents: DataFrame, model: np.ndarray) -> DataFrame:
    """`documents` with score, from 0 to 1: higher if label 1 is likelier. A null text counts as empty and gets the bias's score. The model, 2 MB, is broadcast."""
    shared = documents.sparkSession.sparkContext.broadcast(model.astype("<f8").tobytes())
    documents, back = aside(documents, ("text",), ("score",))
    return back(documents.mapInArrow(_score(shared, documents.columns), with_fields(documents, "score double")))


#: Of labelled rows, those whose crc32(doc_id) modulo the first value is the second are held out of training.
HELD_OUT = (3, 1)


def labelled_texts(documents: DataFrame, labels: DataFrame, label: str, held_out: tuple[int, int]) -> DataFrame:
    """doc_id, text and label of the labelled documents that training may see."""
    seen = labels.where(remainder("doc_id", held_out[0]) != held_out[1]).select("doc_id", F.col(label).alias("label"))
    return documents.select("doc_id", "text").join(seen, "doc_id")


def quality_report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of one half) of every document."""
    model = train_quality(labelled_texts(documents, labels, "quality", HELD_OUT))
    return score_quality(documents.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(remainder("doc_id", HELD_OUT[0]) == HELD_OUT[1], F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_quality(documents: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """`documents` that the classifier, trained on `labels` of `texts`, scores at one half or more."""
    model = train_quality(labelled_texts(texts, labels, "quality", HELD_OUT))
    plain, back = aside(documents, ("doc_id", "text"), ())
    return back(score_quality(plain, model).where(F.col("score") >= 0.5))
