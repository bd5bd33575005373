"""Language identification by sparse multinomial regression on character n-grams.

Texts are read as lower-case letters with everything else as single spaces, and as their
n-grams of 1 to LONGEST characters in hashed buckets. A bucket's weight is its share of the
text's n-grams times its inverse document frequency, counted over all documents to learn
from. The regression is trained by follow the regularised leader with an elastic net on a
bounded sample of each language; part of the sample is held back and gives the temperature
that divides the logits.

Edge cases: a null text or one without a letter is ``und`` with score 0; rows without a
language teach nothing; without any language to learn every row is ``und``; a tie goes to
the first language in order; repeated rows get a row each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspark.llm.learn import learning, per_class_sample, softmax, summed, temperature
from trendspark.llm.tables import arrow_schema, fold, slices, table
from trendspark.scratch import cut

FOLDS, HELD = 4, 2
LONGEST = 3
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
SAMPLE = 1500  # rows of each language that the regression sees
EPOCHS = 3
CALIBRATION = 5  # one row of so many is held back for the temperature
SCALE = 20.0
TOGETHER = 64
UNKNOWN = "und"
RATE, SMOOTH, LASSO, RIDGE = 0.3, 1.0, 0.02, 0.01


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point, its lower-case letter, or a space where it is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, has a letter by document) of all n-grams of each text."""
    code = letters()[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
    begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[at]
    blank = code == 32
    again = np.zeros(len(code), bool)
    again[1:] = blank[1:] & blank[:-1]
    again[begins[:-1][np.diff(begins) > 0]] = False
    begins = np.concatenate(([0], np.cumsum(~again)))[begins]
    code = code[~again].astype(np.uint64)
    n = np.diff(begins)
    doc = np.repeat(np.arange(len(n)), n)
    left = np.repeat(begins[1:], n) - np.arange(len(code))  # characters to the end of the text
    some = np.bincount(doc[code != 32], minlength=len(n)) > 0
    docs, out = [], []
    for size in range(1, LONGEST + 1):
        fits = np.flatnonzero(left >= size)
        key = code[fits]
        for j in range(1, size):
            key = key | code[fits + j] << np.uint64(21 * j)
        if size == 1:
            fits, key = fits[key != 32], key[key != 32]
        docs.append(doc[fits])
        out.append((key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    return np.concatenate(docs), np.concatenate(out), some


def few(batches: Iterator[pa.RecordBatch], limit: int = 1 << 19):
    """Slices of at most TOGETHER rows."""
    for rows, data, at in slices(batches, limit=limit):
        for low in range(0, rows.num_rows, TOGETHER):
            high = min(rows.num_rows, low + TOGETHER)
            yield rows.slice(low, high - low), data[at[low]:at[high]], at[low:high + 1] - at[low]


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, float]:
    """How many documents hold each bucket, and how many there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(BUCKETS + 1)
        for rows, data, at in few(batches):
            doc, bucket, _ = grams(data, at)
            held = np.zeros((rows.num_rows, BUCKETS), bool)
            held[doc, bucket] = True
            total[:-1] += held.sum(0)
            total[-1] += rows.num_rows
        return total

    total = summed(docs.select("text"), count)
    return (total[:-1], total[-1]) if len(total) else (np.zeros(BUCKETS), 0.0)


class Leader:
    """Follow the regularised leader for a softmax over classes, with an elastic net."""

    def __init__(self, classes: int):
        self.z, self.n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) <= LASSO, 0.0, -(z - np.sign(z) * LASSO) / ((SMOOTH + np.sqrt(n)) / RATE + RIDGE))

    def learn(self, rows: np.ndarray, x: np.ndarray, target: int, weight: float) -> None:
        w = self.weights(rows)
        error = softmax(x @ w)
        error[target] -= 1
        g = weight * x[:, None] * error
        self.z[rows] += g - (np.sqrt(self.n[rows] + g * g) - np.sqrt(self.n[rows])) / RATE * w
        self.n[rows] += g * g


def sample_grams(sample: DataFrame):
    """(language, buckets, shares) of each row of a bounded sample, on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in few(batches):
            doc, bucket, _ = grams(data, at)
            key, times = np.unique(doc * BUCKETS + bucket, return_counts=True)
            bounds = np.searchsorted(key, np.arange(rows.num_rows + 1) * BUCKETS)
            which, times = (key % BUCKETS).astype(np.uint16), times.astype(np.uint32)
            yield pa.RecordBatch.from_arrays([
                rows.column("lang"),
                pa.array([which[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                pa.array([times[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())],
                ["lang", "which", "times"])

    found = sample.select("lang", "text").mapInArrow(run, "lang string, which binary, times binary").toPandas()
    out = []
    for lang, which, times in zip(found["lang"], found["which"], found["times"], strict=True):
        times = np.frombuffer(times, np.uint32).astype(float)
        if len(times):
            out.append((lang, np.frombuffer(which, np.uint16).astype(np.int64), times / times.sum()))
    return sorted(out, key=lambda row: (row[0], row[1].tobytes(), row[2].tobytes()))


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, table): what an n-gram of each bucket adds to the logits; the last row is the bias."""
    own = docs.where(learning(F.col("doc_id"), FOLDS, HELD) & F.col("lang").isNotNull())
    own = own.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    chosen, counts = per_class_sample(own.select("doc_id", "lang"), "lang", sample)
    often, rows = document_frequencies(own)
    languages = sorted(counts)
    if not languages:
        return [], np.zeros((BUCKETS + 1, 0))
    rarity = SCALE * np.log((rows + 1) / (often + 1))
    chosen = cut(own.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id"), "language-sample")
    seen = sample_grams(chosen)
    place = {lang: i for i, lang in enumerate(languages)}
    got = np.bincount([place[lang] for lang, _, _ in seen], minlength=len(languages))
    weight = np.array([counts[lang] for lang in languages]) / np.maximum(got, 1)
    weight /= max(weight.max(), 1e-9)
    weight = np.sqrt(weight)  # between the corpus's shares and equal shares
    rng = np.random.default_rng(11)
    order = rng.permutation(len(seen))
    held = order[:len(order) // CALIBRATION] if len(order) >= 10 * CALIBRATION else order[:0]
    leader = Leader(len(languages))

    def row(i: int) -> tuple[np.ndarray, np.ndarray]:
        _, which, share = seen[i]
        return np.append(which, BUCKETS), np.append(share * rarity[which], 1.0)

    for _ in range(EPOCHS):
        for i in rng.permutation(order[len(held):]):
            which, x = row(i)
            target = place[seen[i][0]]
            leader.learn(which, x, target, weight[target])
    w = leader.weights()
    logits = np.array([row(i)[1] @ w[row(i)[0]] for i in held]).reshape(len(held), -1)
    target = np.array([place[seen[i][0]] for i in held], np.int64)
    t = temperature(logits, target, weight[target])
    return languages, np.concatenate((rarity[:, None] * w[:-1], w[-1:])) / t


def languages_of(docs: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score): one row per row of ``docs``."""
    names, weights = fit(docs)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    out_schema, columns = arrow_schema(schema), [np.ascontiguousarray(c) for c in weights[:-1].T]
    bias, listed = weights[-1], np.array([*names, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in slices(batches, limit=1 << 19):
            doc, bucket, some = grams(data, at)
            n = np.maximum(np.bincount(doc, minlength=rows.num_rows), 1)
            if not columns:
                some[:] = False
            best, score = np.full(rows.num_rows, len(names)), np.zeros(rows.num_rows)
            if some.any():
                z = np.stack([np.bincount(doc, c[bucket], rows.num_rows) / n for c in columns], 1) + bias
                p = softmax(z)
                best = np.where(some, p.argmax(1), best)
                score = np.where(some, p.max(1), 0.0)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(listed[best], pa.string()),
                                              pa.array(score, pa.float64())], schema=out_schema)

    return docs.mapInArrow(run, schema)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = languages_of(table(spark, sf_dir, "documents"))
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "lang_pred", "score")
