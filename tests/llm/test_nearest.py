import math

import numpy as np
from pyspark.sql import functions as F

from trendspark.llm import nearest as h

SCHEMA = "vec_id long, embedding array<float>, score double, leaf string"


def brute(rows, every=10, k=20):
    whole = [(i, [float(np.float32(x)) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    queries = {}
    for i, v in sorted(whole):
        if i % every == 0:
            queries.setdefault(i, v)
    out = {}
    for q, v in queries.items():
        scored = []
        for i, w in whole:
            if i != q:
                total = 0.0
                for x, y in zip(v, w):
                    total += x * y
                scored.append((-total, i))
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def found(spark, rows, every=10, **args):
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows], SCHEMA)
    out = {}
    for r in h.nearest_rows(df, F.col("vec_id") % every == 0, **args).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in best}) for q, best in want.items())
    return hits / sum(len(best) for best in want.values())


def vectors(n, width, seed=1, centres=0):
    rng = np.random.default_rng(seed)
    rows = rng.normal(0, 1, (n, width))
    if centres:
        rows = rng.normal(0, 4, (centres, width))[rng.integers(centres, size=n)] + rows
    return [(i, [float(x) for x in row.astype(np.float32)]) for i, row in enumerate(rows)]


def test_one_leaf_is_exact(spark):
    rows = vectors(200, 9)
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, k=3) == brute(rows, k=3)


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(h, "LEAF_ROWS", 24)
    for rows in (vectors(3000, 16, 2), vectors(3000, 16, 3, centres=40)):
        got, want = found(spark, rows), brute(rows)
        assert recall(got, want) >= 0.9
        known = {i: np.array(v) for i, v in rows}
        for q, best in got.items():
            assert len(best) == 20 and len({i for i, _ in best}) == 20
            assert all(abs(known[q] @ known[i] - s) < 1e-9 for i, s in best)
            assert best == sorted(best, key=lambda x: (-x[1], x[0]))


def test_structure_saves_visits():
    rows = np.array([v for _, v in vectors(4000, 16, 3, centres=40)])
    tree = h.fit(rows, 64)
    assert tree.n_leaves == 64
    leaf, order = tree.place(rows), tree.visits(rows[:100], 64)
    assert (np.sort(order, axis=1) == np.arange(64)).all()
    score = rows[:100] @ rows.T
    top = np.argsort(-score, axis=1)[:, 1:21]
    pairs = [(q, leaf[i]) for q in range(100) for i in top[q]]
    visits = h.calibrated(pairs, order, 0.95)
    assert visits <= 16
    when = np.argsort(order, axis=1)
    assert np.mean([when[q, own] < visits for q, own in pairs]) >= 0.95


def test_odd_rows(spark):
    rows = vectors(60, 6)
    rows += [(100 + i, rows[7][1]) for i in range(50)]  # copies: ties go to the smaller id
    rows += [rows[10], (10, rows[3][1]), (None, rows[4][1]), (201, None), (202, [None] + rows[4][1][1:]),
             (210, [float("nan")] + rows[4][1][1:]), (220, [0.0] * 6), (230, []), (240, rows[5][1][:3]),
             (250, rows[5][1] + [2.0]), (260, [float("inf")] * 6)]
    assert found(spark, rows) == brute(rows)


def test_empty_tables_and_few_rows(spark):
    assert found(spark, []) == {}
    assert found(spark, [(1, [1.0]), (2, [1.0])]) == {}
    assert found(spark, [(0, [1.0])]) == {}
    assert found(spark, [(0, [1.0]), (3, [2.0]), (4, [2.0])]) == {0: [(3, 2.0), (4, 2.0)]}


def test_many_copies_and_cells(spark, monkeypatch):
    monkeypatch.setattr(h, "LEAF_ROWS", 16)
    monkeypatch.setattr(h, "CELL_BYTES", 16 * 5 * 4)
    rows = vectors(400, 5) + [(1000 + i, [3.0, 0.0, 0.0, 0.0, 0.0]) for i in range(300)]
    got, want = found(spark, rows, target=1.0), brute(rows)
    assert recall(got, want) >= 0.98
    assert found(spark, rows, target=1.0, sample=10).keys() == want.keys()


def test_cells_hold_runs_of_leaves():
    count = np.array([3, 4, 50, 2, 2, 7, 0])
    first, parts = h.plan_cells(count, 10)
    assert first.tolist() == [0, 0, 1, 6, 6, 7, 7] and parts.tolist() == [1, 1, 5, 1, 1, 1, 1]
