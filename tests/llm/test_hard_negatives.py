import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendspark.llm import hard_negatives as h

SCHEMA = "vec_id long, label int, embedding array<float>, score double, deal string"
NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows, every=10, positives=5, negatives=5):
    whole = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, label, v in rows
             if i is not None and label is not None and v is not None
             and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    anchors = {}
    for i, label, v in sorted(whole):
        if i % every == 0:
            anchors.setdefault(i, (label, v))
    for a, (own, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, label) for i, label, w in whole if i != a)
        for s, p, _ in [x for x in scored if x[2] == own][:positives]:
            fits = [x for x in scored if x[2] != own and 80 * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits)]
    return sorted(out)


def found(spark, rows, **args):
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows], SCHEMA)
    out = h.hard_negatives(df, F.col("vec_id") % 10 == 0, **args)
    return sorted(tuple(r[n] for n in NAMES) for r in out.collect())


def vectors(n, width, seed=1, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(i, int(rng.integers(3)), [float(x) for x in rng.normal(0, spread, width).astype(np.float32)])
            for i in range(n)]


def test_against_brute_force(spark):
    rows = vectors(300, 13)
    assert found(spark, rows) == brute(rows) != []
    assert found(spark, rows, positives=1, negatives=2) == brute(rows, positives=1, negatives=2)


def test_ties_repeats_and_odd_rows(spark):
    rows = vectors(60, 8)
    rows += [(100 + i, i % 3, rows[7][2]) for i in range(40)]  # copies: ties go to the smaller id
    rows += [rows[10], (10, 2, rows[3][2]), (None, 1, rows[4][2]), (200, None, rows[4][2]), (201, 1, None),
             (202, 1, [None] + rows[4][2][1:]), (203, 1, [float("nan")] + rows[4][2][1:]),
             (204, 1, [float("inf")] * 8), (210, 0, []), (211, 0, rows[5][2][:3]), (220, 1, rows[5][2] + [2.0])]
    random.Random(2).shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_all_in_one_label_and_one_vector(spark):
    rows = [(i, 0 if i < 50 else 1, [0.5, -0.25, 1.0]) for i in range(70)]
    assert found(spark, rows) == brute(rows) != []


def test_empty_tables_and_no_anchors(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, 0, [1.0]), (2, 1, [1.0])]) == []
    assert found(spark, [(0, 0, [1.0]), (2, 1, [1.0])]) == []


def test_large_components(spark):
    rows = [(i, label, [x * 1000 for x in v]) for i, label, v in vectors(80, 9, 3)]
    assert found(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="beyond|could reach"):
        found(spark, [(0, 0, [1e30]), (1, 0, [1e30]), (2, 1, [1.0])])


def test_scores_are_inner_products():
    rng = np.random.default_rng(4)
    for low, high in ((-1, 1), (0, 1), (-256, 257), (-70_000, 70_000), (5, 9)):
        rows, anchors = rng.integers(low, high, (50, 21)), rng.integers(low, high, (6, 21))
        planes, groups, bits = h.packed(rows)
        got = h.scores(bits.astype(np.intp), h.subset_sums(anchors, groups, np.int64))
        assert (got == rows @ anchors.T).all()


def test_many_cells(spark, monkeypatch):
    monkeypatch.setattr(h, "ROWS_EACH", 40)
    monkeypatch.setattr(h, "ANCHORS_EACH", 7)
    monkeypatch.setattr(h, "BLOCK", 16)
    rows = vectors(250, 10, 6)
    assert found(spark, rows) == brute(rows)
