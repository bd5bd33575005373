import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.helpers import docs
from trendspark.llm import packing

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def whole_ids(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [packing.END_ID] for i, t in enumerate(texts)}


def check_tiling(pieces, ids):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(ids)
    for doc, parts in by_doc.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[doc])
            assert p.ids_crc32 == zlib.crc32(np.array(ids[doc][at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids[doc])
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.SEQUENCE
        assert at == packing.SEQUENCE or at & (at - 1) == 0  # nothing is padded


def test_given_documents(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in table.select("doc_id", "text").collect()}
    order = sorted(texts)
    ids = whole_ids([texts[k] for k in order])
    check_tiling(packing.op6_packing(spark, sf_dir).collect(), {k: ids[i] for i, k in enumerate(order)})


def test_odd_texts(spark):
    texts = [None, "", " \n\t", "it's  DON'T", "a\x1cb \x1f", "x<|endoftext|>y z", "é ́e É", " a　b c",
             "1234 5½ \U0001f600\U0001f601!?", "wort " * 9000, "q" * 5000, "same text", "same text"]
    ids = whole_ids(texts)
    check_tiling(packing.piece_digests(docs(spark, texts)).collect(), ids)


def test_clashing_columns_and_no_rows(spark):
    table = docs(spark, ["a b", "c"]).withColumnRenamed("lang", "start").withColumnRenamed("source", "ids")
    assert {r.doc_id for r in packing.piece_digests(table).collect()} == {0, 1}
    assert packing.piece_digests(docs(spark, [])).count() == 0


def test_balance():
    lengths = [4000, 3000, 3000, 1500, 1200, 1000, 900, 700, 500, 300, 200, 84] * 40
    pieces = packing.pack(lengths)
    cost, size = defaultdict(float), defaultdict(int)
    for _, _, length, sequence, _ in pieces:
        cost[sequence] += packing.piece_cost(length)
        size[sequence] += length
    full = [cost[s] for s in size if size[s] == packing.SEQUENCE]
    assert max(full) <= 1.5 * min(full)
    cut = len(pieces) - len(lengths)
    assert cut < len(lengths) / 2
