import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from trendspark.llm import collocations as c
from trendspark.llm import words

NAMES = ("lang", "rank", "phrase", "words", "a", "l", "r", "n", "score")


def brute(rows, longest=3, fewest=10, top=2000, cover=50):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            for n in range(1, longest + 1):
                counts[lang].update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= fewest}
        inside = defaultdict(int)
        for p, a in found.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    inside[p[i:i + n]] = max(inside[p[i:i + n]], a)
        best = []
        for p, a in found.items():
            if 100 * inside[p] >= cover * a:
                continue
            score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), len(p), l, r))
        for i, (s, a, p, n, l, r) in enumerate(sorted(best)[:top]):
            out.append((lang, i + 1, p.decode(), n, -a, l, r, totals[lang], -s))
    return sorted(out)


def found(spark, rows, **args):
    table = spark.createDataFrame([(i, t, lang, 1, "x") for i, (lang, t) in enumerate(rows)],
                                  "doc_id long, text string, lang string, words int, phrase string")
    return sorted(tuple(r[n] for n in NAMES) for r in c.collocations(table, **args).collect())


def texts(n, seed=1, vocabulary=12):
    rng = random.Random(seed)
    known = ["The", "a", "Été", "x", "日本", "don't", "b-c", "end", " ", "Z", "o_o", "q"][:vocabulary]
    return [(rng.choice(["en", "fr", None]), "".join(rng.choice(known) + rng.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\n", "\x0b"])
                                                    for _ in range(rng.randint(0, 60)))) for _ in range(n)]


def test_against_brute_force(spark):
    rows = texts(150)
    assert found(spark, rows) == brute(rows) != []
    assert found(spark, rows, fewest=2, top=5) == brute(rows, fewest=2, top=5)


def test_longer_candidates(spark):
    rows = texts(60, 2, 5)
    assert found(spark, rows, longest=5, fewest=4, cover=30) == brute(rows, longest=5, fewest=4, cover=30)
    assert found(spark, rows, longest=2) == brute(rows, longest=2)


def test_odd_rows(spark):
    rows = [("en", None), (None, "und und"), ("und", "und und " * 8), ("en", ""), ("en", " .,;"), ("en", "one"),
            ("", "a b " * 20), ("en", "Repeat me please. " * 400), ("en", "repeat  ME\tplease")] * 3
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [("en", None)]) == []


def test_long_text_and_hot_language(spark, monkeypatch):
    monkeypatch.setattr(c, "CHUNK_BYTES", 1000)
    monkeypatch.setattr(c, "HELD_BYTES", 1500)
    monkeypatch.setattr(c, "RANGE_ENTRIES", 500)
    monkeypatch.setattr(c, "SALT_ROWS", 3)
    rng = random.Random(5)
    long = " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(30_000))
    rows = [("en", long), ("en", "w" * 5000 + " " + "v" * 5000), *texts(200, 6)]
    assert found(spark, rows) == brute(rows)


def test_colliding_hashes_come_apart(spark, monkeypatch):
    plain = words.hashes
    rows = texts(40, 7)
    monkeypatch.setattr(words, "mix", lambda x: x & np.uint64(0xC000000000000003))  # few fingerprints
    monkeypatch.setattr(words, "hashes", lambda *a: plain(*a) & np.uint64(3))
    body = "\n".join(t for _, t in rows).lower().encode() + b"\n"
    data = np.frombuffer(body, np.uint8)
    starts, ends, _ = words.spans(data, np.array([0, len(data)]), c.WORD)
    want = Counter()
    for piece in re.split(b"[.,;:!?\n-\r]", body):
        w = re.findall(b"[^ \t]+", piece)
        want.update(tuple(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    got = Counter()
    for n, (prints, places, counts) in enumerate(c.entries(data, "en", 3), 1):
        assert (np.diff(prints.astype(float)) >= 0).all()
        first = np.searchsorted(starts, places)
        phrases = c._joined(data, starts, ends, first, np.full(len(first), n)).to_pylist()
        for phrase, count in zip(phrases, counts.tolist()):
            assert tuple(phrase.encode().split(b" ")) not in got
            got[tuple(phrase.encode().split(b" "))] = count
    assert got == want


def test_products_beyond_64_bits(spark):
    a = 5_000_000_000
    counts = spark.createDataFrame([("en", 1, "x", 3 * a), ("en", 1, "y", 2 * a), ("en", 2, "x y", a)],
                                   "lang string, words int, phrase string, times long")
    row = c.scored(counts, 3).first()
    assert (row.a, row.l, row.r, row.score) == (a, 3 * a, 2 * a, 10**6 // 6)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_fingerprints_depend_on_words_only(n):
    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**63, 50, dtype=np.uint64)
    one, two = c.fingerprints(h, n, np.uint64(9)), c.fingerprints(np.concatenate((h[20:], h)), n, np.uint64(9))
    assert (one == two[30:]).all() and len(set(one.tolist())) == len(one)
    assert len(c.fingerprints(h[:0], n, np.uint64(9))) == 0


def test_pointers_are_packed():
    places, counts, n = np.array([0, 2**32 - 1, 7]), np.array([1, 2**31, 300]), np.array([1, 3, 2])
    data = c.packed_pointers(places, counts, n)
    assert len(data) == 30
    for got, want in zip(c.from_pointers(data), (places, counts, n), strict=True):
        assert got.tolist() == want.tolist()
