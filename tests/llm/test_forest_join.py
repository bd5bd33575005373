import random
import re
from collections import defaultdict

from tests.llm.helpers import docs, rows
from trendspark.llm import forest_join
from trendspark.llm.components import components

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(texts, threshold=0.8):
    words = [tuple(WORD.findall((t or "").lower())) for t in texts]
    sets = [{w[i:i + 5] for i in range(max(len(w) - 4, 1))} if w else set() for w in words]
    n, parent = len(texts), list(range(len(texts)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    links = defaultdict(int)
    for a in range(n):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return sorted(((d, find(d), links[d]) for d in range(n)), key=repr)


def case():
    random.seed(8)
    pick = lambda n: [random.choice(["ab", "cd", "ef", "gh", "ij", "kl", "mn", "ö"]) + str(random.randrange(50)) for _ in range(n)]
    base, passage = pick(150), pick(60)
    texts = [None, "", "?!", "one two", "One two.", "one two three", " ".join(base), " ".join(base)]
    for i in range(40):
        near = list(base)
        for _ in range(i % 6):
            near[random.randrange(150)] = "new" + str(random.randrange(999))
        texts.append(" ".join(near))
    texts += [" ".join(passage + pick(25)) for _ in range(30)]
    texts += [" ".join(base[:k]) for k in (60, 100, 121, 130)] + [" ".join(pick(400)) for _ in range(5)]
    return texts


def test_against_brute_force(spark):
    texts = case()
    found = forest_join.similar_documents(docs(spark, texts))
    assert rows(found, "doc_id", "class_id", "n_links") == brute(texts)


def test_blocks_give_the_same(spark, monkeypatch):
    texts = case()
    monkeypatch.setattr(forest_join, "BUCKET_BLOCK", 7)
    monkeypatch.setattr(forest_join, "GROUP_BLOCK", 5)
    found = forest_join.similar_documents(docs(spark, texts))
    assert rows(found, "doc_id", "class_id", "n_links") == brute(texts)


def test_stage_and_empty_table(spark):
    table = docs(spark, ["a b c d e f", "A b c d e f!", None, "", "z y x"]).withColumnRenamed("lang", "group")
    kept = forest_join.one_of_each_class(table)
    assert kept.columns == table.columns and rows(kept, "doc_id") == [(0,), (2,), (3,), (4,)]
    assert forest_join.similar_documents(docs(spark, [])).count() == 0


def test_depth_and_agreement():
    assert (1 - 0.8 ** forest_join.forest_depth(0.8)) ** forest_join.TREES <= forest_join.MISSED_BY_FOREST
    assert forest_join.forest_depth(0.9) > forest_join.forest_depth(0.8)
    assert forest_join.least_agreement(0.8, 156) < 0.8 * 156


def test_components(spark):
    random.seed(1)
    path = list(range(200))
    random.shuffle(path)
    edges = list(zip(path, path[1:])) + [(1000, 1001), (1001, 1002), (1000, 1002), (2000, 2000)]
    found = components(spark.createDataFrame(edges, "a long, b long"))
    groups = defaultdict(set)
    for r in found.collect():
        groups[r.root].add(r.node)
    assert sorted(map(sorted, groups.values())) == [list(range(200)), [1000, 1001, 1002]]


def test_null_ids_link(spark):
    words = [f"w{i}" for i in range(100)]
    near, far = " ".join(words + ["more"]), " ".join(f"v{i}" for i in range(50))
    for other in (None, 3):
        table = spark.createDataFrame([(1, " ".join(words)), (other, near), (None, far), (None, far + " x")],
                                      "doc_id long, text string")
        got = {(r.doc_id, r.class_id, r.n_links) for r in forest_join.similar_documents(table).collect()}
        assert got == {(1, 1, 1), (other, 1, 1), (None, None, 1)}
