"""Toxicity by weak supervision.

Voters look at a whole text and fire or not: one for each word of a lexicon, and some
patterns. The lexicon is a short given list and the words and beginnings of words that a
bounded sample of labelled rows shows to go with toxic texts. The votes of all documents to learn from are written
once as bit masks and counted by mask.

The label model is generative: a hidden class, and for each voter how often it fires in
either class; a voter that does not fire abstains. Where a row has a given label, that label is one more voter of fixed accuracy.
It is fitted by expectation maximisation over the counted masks, as Spark sums. Then the
correlations that the hidden class leaves between voters are measured in the same way, the
evidence of voters that fire together is discounted by them, and the model is fitted again.

A linear classifier on words and votes is trained on the posterior labels of a bounded
sample, half of it labelled rows; it generalises from the voters to words that go with them.

Edge cases: a null or empty text fires no voter and gets a score; a missing or null label is
no vote, several labels of one id are averaged; without any labels the given words alone
vote; repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspark.llm import words
from trendspark.llm.learn import hashed_share, known_labels, learning, per_class_sample, sample_texts, sigmoid
from trendspark.llm.tables import arrow_schema, fold, slices, table, utf8
from trendspark.scratch import cut, scope

FOLDS, HELD = 5, 0
SAMPLE = 3000  # labelled rows of each class, and as many rows of any kind, that the classifier sees
MINED = 40
CANDIDATES = 600
FEATURES = 512
LENGTHS = (0, 4, 5, 6, 7, 8)  # whole words, and beginnings of so many bytes
STRETCH = 150
LEVELS = (1, 2, 4)  # a part may count where it stands in a text so many times
STEPS = 10
LABEL_ACCURACY = 0.99

# fixed values: words that are insults wherever they stand
LEXICON = ("idiot", "stupid", "moron", "imbecile", "loser", "scum", "worthless", "disgusting", "pathetic")
PATTERNS = ("shouting", "exclamations", "stretched letters", "many marks", "no letters")


def parts(data: np.ndarray, at: np.ndarray, lengths) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, hash, unit) of whole words (length 0) and of the beginnings of longer words, by length in bytes.

    A whole word counts by itself; a beginning comes up by chance in a long text, so it
    counts by its number per STRETCH words. ``unit`` is the number that counts as one, by text.
    """
    data = words.LOWER[data]
    starts, ends, first = words.spans(data, at, words.ALNUM)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    unit = np.maximum(1, np.diff(first) / STRETCH)
    for length in lengths:
        if length:
            long = ends - starts > length
            yield doc[long], words.mix(words.hashes(data, starts[long], starts[long] + length) + np.uint64(length)), unit
        else:
            yield doc, words.hashes(data, starts, ends), np.ones_like(unit)


def word_hashes(texts: list[str]) -> np.ndarray:
    return next(parts(*utf8(pa.array(list(texts), pa.string())), [0]))[1]


def at_level(found: np.ndarray, level: int) -> np.ndarray:
    """The hash of "this part, so many times at least"."""
    return found if level == 1 else words.mix(found ^ np.uint64(level))


def distinct_parts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) pairs of the distinct parts of each text, at each level that their number reaches."""
    doc, found, unit = (np.concatenate(x) for x in zip(
        *((doc, found, unit[doc]) for doc, found, unit in parts(data, at, LENGTHS)), strict=True))
    order = np.lexsort((found, doc))
    found, doc, unit = found[order], doc[order], unit[order]
    new = np.flatnonzero(np.concatenate(([True], (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])))[:len(found)])
    times = np.diff(np.append(new, len(found))) / unit[new]
    doc, found = doc[new], found[new]
    enough = [times >= level for level in LEVELS]
    doc, found = (np.concatenate(x) for x in ([doc[e] for e in enough],
                                              [at_level(found[e], n) for e, n in zip(enough, LEVELS, strict=True)]))
    order = np.argsort(doc, kind="stable")
    return doc[order], found[order]


class Known:
    """Parts to look for: sorted hashes, and for each length the parts and levels behind them."""

    def __init__(self, hashes: np.ndarray, rows: list[tuple[int, int, int]]):
        self.hashes, self.lengths = hashes, {}
        for length in LENGTHS:
            own = [(np.uint64(part % (1 << 64)), level) for own_length, level, part in rows if own_length == length]
            if own:
                base = np.unique(np.array([part for part, _ in own], np.uint64))
                level = np.array([level for _, level in own])
                which = np.array([part for part, _ in own], np.uint64)
                column = np.searchsorted(hashes, [at_level(p[None], n)[0] for p, n in zip(which, level, strict=True)])
                self.lengths[length] = base, np.searchsorted(base, which), level, column

    def present(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """texts x hashes, True where the text has the part often enough."""
        out = np.zeros((len(at) - 1, len(self.hashes)), bool)
        for (base, which, level, column), (doc, found, unit) in zip(self.lengths.values(), parts(data, at, self.lengths),
                                                               strict=True):
            place, there = listed(found, base)
            times = np.bincount(doc[there] * len(base) + place[there], minlength=len(out) * len(base)).reshape(len(out), -1)
            out[:, column] = times[:, which] >= level * unit[:, None]
        return out


def known_parts(sample: DataFrame, hashes: np.ndarray) -> Known:
    """Finds the parts behind the hashes in the texts of the sample that the hashes come from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, at in slices(batches):
            for length, (_, found, _) in zip(LENGTHS, parts(data, at, LENGTHS), strict=True):
                for level in LEVELS:
                    there = np.unique(found[np.isin(at_level(found, level), hashes)])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(there), length), pa.int32()), pa.array(np.full(len(there), level), pa.int32()),
                        pa.array(there.view(np.int64), pa.int64())], ["length", "level", "part"])

    rows = sample.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "length int, level int, part long")
    given = [(0, 1, int(h.astype(np.int64))) for h in word_hashes([" ".join(LEXICON)]) if h in hashes]
    return Known(hashes, sorted({*given, *(tuple(r) for r in rows.distinct().collect())}))  # a row per hash at most


def _per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


def pattern_votes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """rows x patterns, True where the pattern voter fires."""
    upper = _per_text((data >= 65) & (data <= 90), at)
    letters = upper + _per_text((data >= 97) & (data <= 122) | (data >= 128), at)
    marks = _per_text(data == 33, at)
    other = _per_text(np.isin(data, np.frombuffer(b"#$%&*|<>", np.uint8)), at)
    runs = np.zeros(len(data), bool)
    if len(data) > 3:
        runs[3:] = (data[3:] == data[2:-1]) & (data[2:-1] == data[1:-2]) & (data[1:-2] == data[:-3]) & (data[3:] > 64)
    size = np.maximum(np.diff(at), 1)
    return np.stack([(upper > 0.3 * letters) & (letters > 20), marks > 0.02 * size, _per_text(runs, at) > 0,
                     other > 0.02 * size, letters == 0], 1)


def listed(found: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in sorted ``known`` of each hash, and whether it is there."""
    place = np.minimum(np.searchsorted(known, found), max(len(known) - 1, 0))
    return place, (known[place] == found) if len(known) else np.zeros(len(found), bool)


def sample_parts(sample: DataFrame) -> pd.DataFrame:
    """doc_id, label, distinct hashes and patterns of the texts of a bounded sample, on the driver."""
    schema = T.StructType([sample.schema["doc_id"], T.StructField("label", T.DoubleType()),
                           T.StructField("found", T.BinaryType()), T.StructField("patterns", T.BinaryType())])
    out_schema = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in slices(batches):
            doc, found = distinct_parts(data, at)
            bounds = np.searchsorted(doc, np.arange(rows.num_rows + 1))
            yield pa.RecordBatch.from_arrays([
                rows.column("doc_id"), rows.column("label"),
                pa.array([found[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                pa.array([x.tobytes() for x in pattern_votes(data, at)], pa.binary())], schema=out_schema)

    rows = sample.select("doc_id", F.col("text").cast("string").alias("text"), F.col("label").cast("double").alias("label"))
    found = rows.mapInArrow(run, schema).toPandas()
    found["found"] = [np.frombuffer(x, np.uint64) for x in found["found"]]
    found["patterns"] = [np.frombuffer(x, bool) for x in found["patterns"]]
    return found


def frequencies(found: list[np.ndarray], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, rows that hold each, weight of those rows)."""
    if not len(found):
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    every, place, often = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    return every, often, np.bincount(place, np.repeat(weight, [len(x) for x in found]), len(every))


def association(often: np.ndarray, heavy: np.ndarray, rows: float, total: float) -> np.ndarray:
    """Signed likelihood ratio of a word and the class: above 0 where the class has it more often."""
    rest, rest_total = often - heavy, rows - total
    p, q = (heavy + 0.5) / (total + 1), (rest + 0.5) / (rest_total + 1)
    both = (often + 1) / (rows + 2)
    gain = heavy * np.log(p / both) + rest * np.log(q / both)
    return np.where(p > q, gain, -gain)


def mined_lexicon(found: list[np.ndarray], label: np.ndarray, most: int = MINED) -> np.ndarray:
    """Sorted hashes of the given words and of the parts of words that go with label 1.

    Candidates are taken from the strongest on; one that stands in nearly the same texts as
    one taken before is passed over.
    """
    every, often, heavy = frequencies(found, label)
    gain = association(often, heavy, len(label), label.sum())
    precise = np.flatnonzero((heavy >= 3) & (heavy / np.maximum(often, 1) > 0.6) & (gain > 3))
    best = np.sort(precise[np.argsort(-gain[precise], kind="stable")[:CANDIDATES]])
    where = presence(found, every[best])
    taken: list[int] = []
    for i in np.argsort(-gain[best], kind="stable").tolist():
        both = (where[:, taken] & where[:, [i]]).sum(0)
        either = where[:, taken].sum(0) + where[:, i].sum() - both
        if len(taken) < most and not (both > 0.8 * either).any():
            taken.append(i)
    return np.unique(np.concatenate((every[best[taken]], word_hashes([" ".join(LEXICON)]))))


def presence(found: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    """texts x known from the distinct hashes of each text."""
    out = np.zeros((len(found), len(known)), bool)
    if len(found):
        doc, flat = np.repeat(np.arange(len(found)), [len(x) for x in found]), np.concatenate(found)
        place, there = listed(flat, known)
        out[doc[there], place[there]] = True
    return out


class LabelModel:
    """A hidden class, firing rates of each voter in either class, and correlations that the class leaves."""

    def __init__(self, rate: np.ndarray, prior: float):
        self.rate, self.prior, self.shared = rate, prior, np.eye(len(rate))  # rate: voters x (clean, toxic)

    def posterior(self, votes: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Voters that do not fire abstain: most know one language or one kind of insult only."""
        evidence = votes @ np.log(self.rate[:, 1] / self.rate[:, 0])
        # n correlated voters count as n / (1 + (n - 1) x mean correlation) independent ones
        fired, together = votes.sum(1), ((votes @ self.shared) * votes).sum(1)
        z = np.log(self.prior / (1 - self.prior)) + evidence * fired / np.maximum(together, 1e-9)
        given = np.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY)) * (2 * np.nan_to_num(label, nan=0.5) - 1)
        return sigmoid(z + given)


def unpacked(mask: np.ndarray, voters: int) -> np.ndarray:
    return (mask[:, None] >> np.arange(voters) & 1).astype(float)


def _summed(masks: DataFrame, voters: int, sums) -> np.ndarray:
    """Sum over all counted masks of ``sums(votes, label, times)``, an array of fixed size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            total = sums(unpacked(rows["mask"].to_numpy(), voters), rows["label"].to_numpy(float), rows["times"].to_numpy(float))
            yield pd.DataFrame({"place": np.arange(total.size), "value": total.reshape(-1)})

    rows = masks.mapInPandas(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(max((r.place for r in rows), default=-1) + 1)
    for r in rows:
        out[r.place] = r.value
    return out


def fit_label_model(masks: DataFrame, rate: np.ndarray, prior: float, steps: int = STEPS) -> LabelModel:
    """Expectation maximisation over (mask, label, times), correlations, and once more."""
    model, voters = LabelModel(rate, prior), len(rate)
    for turn in range(2):
        for _ in range(steps // 2):
            def sums(votes, label, times, model=model):
                p = model.posterior(votes, label)
                return np.stack([np.append((times * (1 - p)) @ votes, (times * (1 - p)).sum()),
                                 np.append((times * p) @ votes, (times * p).sum())])

            total = _summed(masks, voters, sums)
            if not len(total):
                return model
            total = total.reshape(2, voters + 1)
            # a pseudo-count of ten rows that behave as before keeps rates off 0 and 1
            model.rate = ((total[:, :voters] + 10 * model.rate.T) / (total[:, voters:] + 10)).T.clip(1e-6, 1 - 1e-6)
        if turn == 0:
            def products(votes, label, times, model=model):
                p = model.posterior(votes, label)
                return np.stack([
                    ((votes - model.rate[:, c]) * (times * (p if c else 1 - p))[:, None]).T @ (votes - model.rate[:, c])
                    for c in (0, 1)])

            shared = _summed(masks, voters, products).reshape(2, voters, voters).sum(0)
            spread = np.sqrt(np.maximum(shared.diagonal(), 1e-9))
            correlation = shared / spread[:, None] / spread[None, :]
            model.shared = np.maximum(correlation, 0)
            np.fill_diagonal(model.shared, 1)
    return model


def train_linear(x: np.ndarray, target: np.ndarray, weight: np.ndarray, penalty: float = 1.0,
                 steps: int = 25) -> np.ndarray:
    """Weights and bias of a logistic classifier on soft targets, by Newton steps."""
    x = np.concatenate((x, np.ones((len(x), 1), np.float32)), 1)
    w, ridge = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, penalty), 1e-6)
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (weight * (target - p)) - ridge * w
        bend = (x * (weight * np.maximum(p * (1 - p), 1e-4)).astype(np.float32)[:, None]).T @ x
        move = np.linalg.solve(bend.astype(float) + np.diag(ridge + 1e-3), gradient)
        w += move
        if np.abs(move).max() < 1e-3:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """(lexicon, features, weights with the bias last)."""
    own = docs.where(learning(F.col("doc_id"), FOLDS, HELD)).select("doc_id", F.col("text").cast("string").alias("text"))
    known = cut(known_labels(labels, "toxic", FOLDS, HELD).withColumn("toxic", F.col("label") >= 0.5), "toxic-labels")
    chosen, counts = per_class_sample(known, "toxic", sample)
    texts = cut(sample_texts(own, chosen.select("doc_id", "label")), "toxic-sample")
    labelled = sample_parts(texts)
    label = labelled["label"].to_numpy(float)
    lexicon = mined_lexicon(list(labelled["found"]), (label >= 0.5).astype(float))
    voters, lexicon_parts = len(lexicon) + len(PATTERNS), known_parts(texts, lexicon)

    def mask_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in slices(batches):
            votes = np.concatenate((lexicon_parts.present(data, at), pattern_votes(data, at)), 1)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(votes @ (1 << np.arange(voters)), pa.int64())],
                                             ["doc_id", "mask"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    masks = own.mapInArrow(mask_rows, f"doc_id {id_type}, mask long").join(known, "doc_id", "left")
    masks = cut(masks.groupBy("mask", "label").agg(F.count("*").alias("times")), "votes")
    # starting rates: words fire seldom but nearly always rightly
    rate = np.tile([0.002, 0.2], (voters, 1))
    rate[len(lexicon):] = 0.05
    total = sum(counts.values())
    model = fit_label_model(masks, rate, (counts.get(True, 0) + 1) / (total + 10))

    size = max(masks.agg(F.sum("times")).first()[0] or 0, 1)
    # a bounded number of ids without a label, then their texts
    free = own.where(hashed_share(F.col("doc_id"), F.lit(min(1.0, sample / size)))).select("doc_id")
    free = cut(free.join(known, "doc_id", "left_anti").distinct(), "free-ids").withColumn("label", F.lit(None).cast("double"))
    free_texts = cut(sample_texts(own, free), "free-sample")
    seen = pd.concat([x for x in (labelled, sample_parts(free_texts)) if len(x)] or [labelled])
    found, label = list(seen["found"]), seen["label"].to_numpy(float)
    votes = np.concatenate((presence(found, lexicon), np.stack([*seen["patterns"], np.zeros(len(PATTERNS), bool)])[:-1]), 1)
    target = model.posterior(votes.astype(float), label)
    # rows of a class stand for all rows of it
    each = {c: counts.get(c, 0) / max(int(((label >= 0.5) == c)[~np.isnan(label)].sum()), 1) for c in (False, True)}
    weight = np.where(np.isnan(label), 1.0, np.where(label >= 0.5, each[True], each[False]))
    every, often, heavy = frequencies(found, target)
    gain = association(often, heavy, len(found), target.sum())
    usable = np.flatnonzero((often >= 3) & (gain > 4))
    features = np.sort(every[usable[np.argsort(-gain[usable], kind="stable")[:FEATURES]]])
    weights = train_linear(np.concatenate((presence(found, features), votes), 1).astype(np.float32), target, weight)
    everything = texts.select("text").union(free_texts.select("text"))
    return lexicon_parts, known_parts(everything, features), weights


def scorer(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """A function that scores texts, given as bytes and where each begins; it is sent to the tasks."""
    lexicon, features, weights = fit(docs.select("doc_id", F.col("text").cast("string").alias("text")), labels, sample)

    def scores(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        x = np.concatenate((features.present(data, at), lexicon.present(data, at), pattern_votes(data, at)), 1)
        return sigmoid(x @ weights[:-1] + weights[-1])

    return scores


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score): one row per row of ``docs``."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scores = scorer(docs, labels, sample)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    out_schema = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in slices(batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(scores(data, at), pa.float64())],
                                             schema=out_schema)

    return docs.mapInArrow(run, schema)


def not_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below one half, with all their columns; filtered where they are read."""
    with scope():
        scores = scorer(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in slices(batches):
            yield rows.filter(pa.array(scores(data, at) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
