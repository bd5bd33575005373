"""Quality scores from random-indexing word vectors and a small network.

Every word falls into one of BUCKETS buckets, and every bucket has a random index vector:
a few entries of plus or minus one. The context vector of a bucket is the sum of the index
vectors of the words next to its words, over all documents. A document is the mean, over
its words, of context and index vectors. Words keep their case, and runs of punctuation are
words; two more words stand for "in capitals" and "the same as the word before".

A network of two layers, written in numpy, is trained on a bounded sample of labelled rows
of each class, weighted to the classes' true shares. Part of the sample is held back and
gives the temperature that divides the logits.

Edge cases: a null or empty text has no words, its vector is zero and it gets a score;
several labels of an id are averaged, null labels ignored; without labels every score is
one half; repeated rows get a row each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspark.llm import words
from trendspark.llm.learn import known_labels, per_class_sample, sample_texts, sigmoid, summed, temperature
from trendspark.llm.tables import arrow_schema, fold, slices, table
from trendspark.scratch import cut

FOLDS, HELD = 5, 0
BUCKET_BITS = 13
BUCKETS = 1 << BUCKET_BITS
CAPITALS, AGAIN = BUCKETS, BUCKETS + 1
SIZE = 32
ENTRIES = 4
REACH = 2
SAMPLE = 4000  # labelled rows of each class that the network sees
CALIBRATION = 5
HIDDEN = 24
EPOCHS = 300
THRESHOLD = 0.3
TOGETHER = 128

_rng = np.random.default_rng(77)
PLACES = _rng.integers(0, SIZE, (BUCKETS + 2, ENTRIES))
SIGNS = _rng.choice([-1.0, 1.0], (BUCKETS + 2, ENTRIES))
MARKS = words.byte_class(rb"[!-/:-@\[-`{-~]")
KIND = words.SPACED & (np.arange(256) > 32)
UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)


def index_vectors() -> np.ndarray:
    out = np.zeros((BUCKETS + 2, SIZE))
    np.add.at(out, (np.arange(BUCKETS + 2)[:, None], PLACES), SIGNS)
    return out


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, in capitals, same as before) of the words and punctuation runs of each text."""
    kind = KIND[data].astype(np.int8) + MARKS[data]  # 0 space, 1 word, 2 punctuation
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[at] = True
    places = np.flatnonzero(edge)
    starts, ends = places[:-1], places[1:]
    some = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[some], ends[some]
    doc = np.searchsorted(at, starts, "right") - 1
    found = words.hashes(data, starts, ends)
    upper = np.concatenate(([0], np.cumsum(UPPER[data])))
    capitals = (upper[ends] - upper[starts] == ends - starts) & (ends - starts > 1)
    again = np.zeros(len(found), bool)
    again[1:] = (found[1:] == found[:-1]) & (doc[1:] == doc[:-1])
    return doc, (found >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), capitals, again


def few(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20):
    for rows, data, at in slices(batches, limit=limit):
        for low in range(0, rows.num_rows, TOGETHER):
            high = min(rows.num_rows, low + TOGETHER)
            yield rows.slice(low, high - low), data[at[low]:at[high]], at[low:high + 1] - at[low]


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vector of each bucket, from all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((BUCKETS + 2) * SIZE)
        for _, data, at in slices(batches, limit=1 << 20):
            doc, bucket, _, _ = tokens(data, at)
            for away in range(1, REACH + 1):
                same = doc[away:] == doc[:-away]
                one, two = bucket[:-away][same], bucket[away:][same]
                for a, b in ((one, two), (two, one)):
                    for entry in range(ENTRIES):
                        total += np.bincount(a * SIZE + PLACES[b, entry], SIGNS[b, entry], len(total))
        return total

    total = summed(docs.select(F.col("text").cast("string").alias("text")), count)
    total = total.reshape(-1, SIZE) if len(total) else np.zeros((BUCKETS + 2, SIZE))
    return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)


def document_vectors(data: np.ndarray, at: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean vector of the words of each text."""
    doc, bucket, capitals, again = tokens(data, at)
    n, wide = len(at) - 1, len(vectors)
    doc = np.concatenate((doc, doc[capitals], doc[again]))
    bucket = np.concatenate((bucket, np.full(capitals.sum(), CAPITALS), np.full(again.sum(), AGAIN)))
    times = np.bincount(doc * wide + bucket, minlength=n * wide).reshape(n, wide)
    return (times.astype(np.float32) @ vectors) / np.maximum(times.sum(1, keepdims=True), 1).astype(np.float32)


class Network:
    """Two layers: tanh units, and one logit."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, hidden: int = HIDDEN):
        rng = np.random.default_rng(5)
        self.mean, self.spread, self.temperature = mean, spread, 1.0
        self.p = [rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), hidden)), np.zeros(hidden),
                  rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]

    def logit(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.p
        return np.tanh(((x - self.mean) / self.spread) @ a + b) @ c + d[0]

    def train(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02,
              decay: float = 1e-3) -> None:
        """Adam steps on the weighted logistic loss of all rows."""
        x, weight = (x - self.mean) / self.spread, weight / weight.sum()
        one, two = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p]
        for step in range(1, epochs + 1):
            a, b, c, d = self.p
            h = np.tanh(x @ a + b)
            error = weight * (sigmoid(h @ c + d[0]) - y)
            back = error[:, None] * c * (1 - h * h)
            gradients = [x.T @ back + decay * a, back.sum(0), h.T @ error + decay * c, np.array([error.sum()])]
            for i, g in enumerate(gradients):
                one[i] = 0.9 * one[i] + 0.1 * g
                two[i] = 0.999 * two[i] + 0.001 * g * g
                self.p[i] = self.p[i] - rate * (one[i] / (1 - 0.9 ** step)) / (np.sqrt(two[i] / (1 - 0.999 ** step)) + 1e-8)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, Network | None]:
    """(vectors of all buckets, network)."""
    vectors = np.concatenate((context_vectors(docs), index_vectors() / np.sqrt(ENTRIES)), 1).astype(np.float32)
    known = cut(known_labels(labels, "quality", FOLDS, HELD).withColumn("good", F.col("label") >= 0.5), "quality-labels")
    chosen, counts = per_class_sample(known, "good", sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in few(batches):
            x = document_vectors(data, at, vectors)
            yield pa.RecordBatch.from_arrays([rows.column("good"), pa.array([v.tobytes() for v in x], pa.binary())],
                                             ["good", "vector"])

    seen = sample_texts(docs.select("doc_id", F.col("text").cast("string").alias("text")), chosen.select("doc_id", "good"))
    seen = seen.mapInArrow(run, "good boolean, vector binary").toPandas().sort_values(["good", "vector"])
    if not len(seen):
        return vectors, None
    x = np.stack([np.frombuffer(v, np.float32) for v in seen["vector"]]).astype(float)
    y = seen["good"].to_numpy(float)
    weight = np.where(y > 0, counts.get(True, 0) / max(y.sum(), 1), counts.get(False, 0) / max((1 - y).sum(), 1))
    order = np.random.default_rng(3).permutation(len(y))
    held = order[:len(order) // CALIBRATION] if len(order) >= 10 * CALIBRATION else order[:0]
    rest = order[len(held):]
    network = Network(x[rest].mean(0), x[rest].std(0) + 1e-3)
    network.train(x[rest], y[rest], weight[rest])
    z = network.logit(x[held])
    network.temperature = temperature(np.stack((np.zeros_like(z), z), 1), y[held].astype(int), weight[held])
    return vectors, network


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score): one row per row of ``docs``."""
    vectors, network = fit(docs, labels, sample)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    out_schema = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in few(batches):
            score = np.full(rows.num_rows, 0.5)
            if network:
                score = sigmoid(network.logit(document_vectors(data, at, vectors)) / network.temperature)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(score, pa.float64())], schema=out_schema)

    return docs.mapInArrow(run, schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
