import hashlib
import random
import re

import pyarrow.parquet as pq

from tests.llm.helpers import docs, rows
from trendspark import scratch
from trendspark.llm import decontaminate

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(texts, items):
    out = []
    for doc, text in enumerate(texts):
        w, hit, found = words(text), set(), set()
        for item, body in items:
            b = words(body)
            windows = {tuple(b[i:i + 10]) for i in range(max(len(b) - 9, 1))} if b else set()
            for i in range(len(w)):
                for window in windows:
                    if tuple(w[i:i + len(window)]) == window:
                        hit.update(range(i, i + len(window)))
                        found.add(item or "")
        ids = ",".join(sorted(found))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


NAMES = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def table(spark, items):
    return spark.createDataFrame(items, "item_id string, text string")


def case():
    random.seed(4)
    vocabulary = ["alpha", "beta", "gamma", "delta", "é1", "über", "the", "of"]
    long = [random.choice(vocabulary) for _ in range(60)]
    items = [("10", " ".join(long[:25])), ("9", " ".join(long[30:42]).upper()), ("short", "one, two three"),
             ("short", "one two-three"), (None, "lonely"), ("none", " . ! "), ("null", None)]
    texts = [None, "", "...", " ".join(long), " ".join(long[:9]), " ".join(long[:10]), "x " * 50 + "; ".join(long[28:45]),
             "One. TWO; three one two three", "one two", "lonely lonely", " ".join(long[:10]) * 2, "three one two three"]
    texts += [" ".join(random.choice(vocabulary) for _ in range(30)) for _ in range(20)]
    return texts, items


def test_against_brute_force(spark):
    texts, items = case()
    found = decontaminate.contamination_digests(docs(spark, texts), table(spark, items))
    assert rows(found, *NAMES) == brute(texts, items)


def test_portions_give_the_same(spark):
    texts, items = case()
    one = decontaminate.contamination(docs(spark, texts), table(spark, items))
    many = decontaminate.contamination(docs(spark, texts), table(spark, items), item_bytes=40)
    assert rows(one, "doc_id", "n_words", "hits", "items") == rows(many, "doc_id", "n_words", "hits", "items")


def test_proximity(spark):
    texts = ["c x b y a", "c x x x x x x b a", "a b", "b c a", None]
    found = decontaminate.contamination(docs(spark, texts), table(spark, [("i", "a b c")]), within=4)
    assert [r.doc_id for r in found.where("size(hits) > 0").collect()] == [0, 3]


def test_stage_and_empty_tables(spark):
    table_of = docs(spark, ["one two three", "clean", None]).withColumnRenamed("lang", "hits").withColumnRenamed("source", "row_sha")
    items = table(spark, [("i", "one two three")])
    kept = decontaminate.clean(table_of, items)
    assert kept.columns == table_of.columns and rows(kept, "doc_id") == [(1,), (2,)]
    assert decontaminate.contamination(docs(spark, []), items).count() == 0
    assert rows(decontaminate.contamination_digests(docs(spark, ["a"]), table(spark, [])), "doc_id", "n_hit") == [(0, 0)]


def test_no_row_group_of_the_index_holds_many_blocks(spark, monkeypatch):
    written = []

    def kept(df, label, **how):
        written.append(scratch.cut(df, label, **how))
        return written[-1]

    build = decontaminate.build_index
    monkeypatch.setattr(scratch, "GROUP_BYTES", 1 << 10)
    monkeypatch.setattr(decontaminate, "build_index", lambda docs: build(docs, block_words=1))
    monkeypatch.setattr(decontaminate, "cut", kept)
    text = " ".join(f"w{i}" for i in range(2000)) + " "
    docs = spark.createDataFrame([(i, text * 250) for i in range(4)], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([("a", "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14")], "item_id string, text string")
    found = decontaminate.contamination(docs, items).collect()
    assert [len(r.hits) for r in found] == [250] * 4
    place = next(df for df in written if "positions" in df.columns).inputFiles()
    files = [pq.ParquetFile(path.removeprefix("file:")) for path in place]
    groups = [f.metadata.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
    assert sum(groups) == 4 and max(groups) == 1
