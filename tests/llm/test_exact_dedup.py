import hashlib
import random
from collections import defaultdict

import numpy as np

from tests.llm.helpers import docs, rows
from trendspark.llm import exact_dedup


def brute(pairs):
    groups = defaultdict(list)
    for doc, text in pairs:
        groups[text or ""].append(doc)
    out, seen = [], set()
    for doc, text in pairs:
        same = groups[text or ""]
        best = max(same, key=lambda d: (d is not None, d))
        kept = doc == best and (text or "") not in seen
        if kept:
            seen.add(text or "")
        out.append((doc, best, len(same), kept, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


NAMES = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_against_brute_force(spark):
    random.seed(5)
    long = "".join(random.choice("abcdefgh \né") for _ in range(60_000))
    texts = [None, "", "a", "a", "a ", "A", long, long, long + "x", long[1:], "é", "é", "zz" * 40_000] + ["hot"] * 40
    found = exact_dedup.exact_duplicates(docs(spark, texts))
    assert rows(found, *NAMES) == brute(list(enumerate(texts)))


def test_repeated_rows_and_ids(spark):
    pairs = [(7, "a"), (7, "a"), (3, "a"), (7, "b"), (None, "a"), (None, "c"), (None, "c")]
    table = spark.createDataFrame(pairs, "doc_id long, text string")
    assert rows(exact_dedup.exact_duplicates(table), *NAMES) == brute(pairs)
    kept = exact_dedup.keep_first(table, exact_dedup.exact_duplicates(table))
    assert rows(kept, "doc_id", "text") == sorted([(7, "a"), (7, "b"), (None, "c")], key=repr)


def test_stage_keeps_columns(spark):
    table = docs(spark, ["a", "b", "a"]).withColumnRenamed("lang", "kept").withColumnRenamed("source", "row_sha")
    out = exact_dedup.keep_first(table, exact_dedup.exact_duplicates(table))
    assert out.columns == table.columns
    assert rows(out, "doc_id") == [(1,), (2,)]
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0


def test_cuts_depend_on_content_only():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, 300_000, dtype=np.uint8)
    moved = np.concatenate((rng.integers(97, 123, 777, dtype=np.uint8), data))

    def parts(text):
        bounds = exact_dedup.chunk_bounds(exact_dedup.cut_places(text), 0, len(text))
        assert bounds[0] == 0 and bounds[-1] == len(text)
        assert max(np.diff(bounds)) <= exact_dedup.LONGEST
        return [text[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]

    one, two = parts(data), parts(moved)
    assert len(set(one) & set(two)) > 0.9 * len(one)


def test_collision_is_noticed(spark):
    parts = spark.createDataFrame([(b"i", b"x"), (b"i", b"y")], "chunk_id binary, chunk binary")
    assert not exact_dedup.verified(parts)
    assert exact_dedup.verified(parts.where("chunk = X'78'"))
