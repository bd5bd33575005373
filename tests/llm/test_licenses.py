import math
import re
import textwrap

from tests.llm.helpers import rows
from trendspark.llm import licenses

MIT = "Released under the MIT License."
FILES = [
    (1, "a/LICENSE", MIT), (2, "a/b/c/x.py", "code\nmore code"), (3, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0."),
    (4, "a/b/c/y.py", "some words here and there " * 6 + f"\n// {MIT}\nrest of it is code code code"),
    (5, "z/q.py", "a license to be free"), (6, "top.txt", None), (7, None, ""), (8, "a/b2/x", "x"), (8, "a/b2/x", "x"),
    (9, "a/n/deep/er/f", "mit dem und under the"), (10, "z/cc.txt", "Licensed under CC BY-NC 4.0."),
]


def table(spark, files=FILES):
    return spark.createDataFrame(files, "doc_id long, path string, text string")


def cosine(line, weights):
    words = [w for w in re.split("[^a-z0-9]+", line.lower()) if w in weights.idf]
    own = {w: words.count(w) * weights.idf[w] for w in words}
    norm = math.sqrt(sum(v * v for v in own.values())) or 1.0
    return max(sum(v * t.get(w, 0.0) for w, v in own.items()) / norm for t in weights.vectors)


def test_inheritance(spark):
    found = {(r.doc_id): (r.license, r.origin, r.source_dir) for r in licenses.license_scan(table(spark)).collect()}
    assert found == {
        1: ("MIT", "file", "a"), 2: ("Apache-2.0", "inherited", "a/b"), 3: ("Apache-2.0", "file", "a/b"),
        4: ("MIT", "header", "a/b/c"), 5: ("CC-BY-NC-4.0", "inherited", "z"), 6: (None, "none", None), 7: (None, "none", None),
        8: ("MIT", "inherited", "a"), 9: ("MIT", "inherited", "a"), 10: ("CC-BY-NC-4.0", "file", "z")}
    assert licenses.license_scan(table(spark)).count() == len(FILES)
    assert licenses.license_scan(table(spark, [])).count() == 0


def test_scores_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    often = {w: sum(w in set(re.split("[^a-z0-9]+", t.lower())) for t in texts.values()) for w in licenses.VOCABULARY}
    weights = licenses.Weights(often, len(texts))
    got = licenses.headers(licenses.document_files(docs), weights)
    best = {k: max(cosine(line, weights) for line in t.split("\n")) for k, t in texts.items()}
    want = sorted((k, round(v, 9)) for k, v in best.items() if v >= licenses.THRESHOLD)
    assert sorted((r.doc_id, round(r.own_score, 9)) for r in got.where("own_score is not null").collect()) == want
    assert {w: n for w, n in licenses.document_frequencies(licenses.document_files(docs))[0].items()} == {w: n for w, n in often.items() if n}
    assert rows(licenses.op10_licenses(spark, sf_dir), "doc_id") == sorted(((k,) for k in texts), key=repr)


def test_wrapped_notices(spark):
    """Notices wrapped at 72 columns as comments, inside a long line, and in a licence file."""
    notices = {t: name for name, t in licenses.TEMPLATES if len(t) > 100}
    code = [f"value{i} = call{i}(item{i}, row{i})" for i in range(60)]
    files, want = [], {}
    for i, (text, name) in enumerate(notices.items()):
        lines = textwrap.wrap(text, 72)
        files += [(3 * i, f"p{i}/x.py", "\n".join([*code[:20], *("# " + line for line in lines), *code])),
                  (3 * i + 1, f"q{i}/x.py", " ".join([*code, text, *code])),
                  (3 * i + 2, f"r{i}/LICENSE", "\n".join(["Copyright 2020 Somebody", "", *lines, "", *code])),
                  (100 + i, f"r{i}/deep/y.py", "\n".join(code))]
        want |= {3 * i: (name, "header"), 3 * i + 1: (name, "header"), 3 * i + 2: (name, "file"), 100 + i: (name, "inherited")}
    files += [(200 + i, f"s/{i}.py", "\n".join(code)) for i in range(20)]
    table_of = table(spark, files)
    got = {r.doc_id: r for r in licenses.license_scan(table_of).collect()}
    assert {k: (got[k].license, got[k].origin) for k in want} == want
    assert all(got[200 + i].origin == "none" for i in range(20))
    assert {got[3 * i].license for i in range(len(notices))} >= {"MIT", "BSD-3-Clause", "GPL-3.0"}
