"""Cost-balanced packing of token ids into sequences.

A sequence costs what its pieces cost: a linear part per token and a quadratic part per
piece, since attention stays within a document. Pieces are taken from the longest to the
shortest, and each goes to the cheapest sequence that still has room for it. Where no
sequence has room, the piece is cut to fill the emptiest one and its rest goes on.

Documents are packed in groups of about GROUP_TOKENS ids within a task, so a task holds one
group whatever the size of the table, and no row is shuffled. A group opens exactly as many
sequences as its ids fill: full ones, and for the rest sequences whose lengths are powers
of two, which need no padding.

Edge cases: a null or empty text is its end id alone. A document longer than a sequence is
cut into full sequences and a rest. Equal lengths keep the order of the rows. Repeated rows
are packed each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspark.llm.tables import arrow_schema, slices, table

SEQUENCE = 4096
END_ID = 2
GROUP_TOKENS = 1 << 22
HIDDEN = 1024  # width of the model that the cost estimate assumes
CACHED_WORDS = 400_000
TOGETHER = 128  # words in one text to encode
WORD_END = "</w>"
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^`{|}~"
PARTITION_BITS = 40

# Where splitting at white space could differ from the tokenizer: its special strings, and
# the separators that Python counts as white space and the tokenizer does not.
_UNSAFE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")


class WordTokenizer:
    """Token ids of texts under a tokenizer that drops white space: ids of each word, looked up once.

    Ids are little-endian unsigned 32-bit numbers, end to end. Words that are letters and then
    ASCII marks are letters and marks to the tokenizer too, so new ones are encoded by their
    letters, many in one call, and told apart by the tokens that end a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        size = self.whole.get_vocab_size()
        self.last = np.array([(self.whole.id_to_token(i) or "").endswith(WORD_END) for i in range(size)])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encoded(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Encode words of letters, many at once."""
        groups = [words[low:low + TOGETHER] for low in range(0, len(words), TOGETHER)]
        texts = [" ".join(group) for group in groups]
        for group, found in zip(groups, self.whole.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(ends) == len(group):
                data = ids.tobytes()
                for word, start, end in zip(group, [0, *ends[:-1]], ends, strict=True):
                    self.known[word] = data[4 * start:4 * end]
            else:  # a letter that lower-casing makes two characters
                self.known.update((word, self.encoded(word)) for word in group)

    def look_up(self, words: set[str]) -> None:
        """Make sure that all words are known."""
        if len(self.known) > CACHED_WORDS:
            self.known, self.older = {}, self.known
        words = words.difference(self.known)
        if self.older:
            again = words.intersection(self.older)
            self.known.update(zip(again, map(self.older.__getitem__, again), strict=True))
            words -= again
        new, marked, stems = set(), [], []
        for word in words:
            if word.isalpha():
                new.add(word)
                continue
            stem = word.rstrip(MARKS)
            if stem.isalpha():
                marked.append(word)
                stems.append(stem)
            else:
                self.known[word] = self.encoded(word)
        new.update(stems)
        self.learn(list(new.difference(self.known)))
        known = self.known
        for word, stem in zip(marked, stems, strict=True):
            marks = word[len(stem):]
            if marks not in known:
                known[marks] = self.encoded(marks)
            known[word] = known[stem] + known[marks]

    def ids(self, texts: list[str]) -> list[bytes]:
        plain = [None if any(map(text.__contains__, _UNSAFE)) else text.split() for text in texts]
        self.look_up(set().union(*(words for words in plain if words)))
        get = self.known.__getitem__
        return [self.encoded(text) if words is None else b"".join(map(get, words))
                for text, words in zip(texts, plain, strict=True)]


@lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordTokenizer:
    """One per Python worker, so that tasks find the words of the tasks before them."""
    return WordTokenizer(path)


def piece_cost(length: np.ndarray | int, hidden: int = HIDDEN):
    """Linear work per token plus attention within the piece, in units of the linear work of one token."""
    return length + length * length / (6.0 * hidden)


def pack(lengths: list[int], sequence: int = SEQUENCE, hidden: int = HIDDEN) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; every sequence is full.

    Sequences are numbered from 0. All hold ``sequence`` ids but the last ones, whose lengths
    are the binary digits of what is left.
    """
    pieces, opened, rest = [], 0, []
    for doc, length in enumerate(lengths):
        start = 0
        while length - start >= sequence:
            pieces.append((doc, start, sequence, opened, 0))
            opened += 1
            start += sequence
        if length > start:
            rest.append((length - start, doc, start))
    rest.sort(key=lambda item: (-item[0], item[1]))
    total = sum(item[0] for item in rest)
    sizes = [sequence] * (total // sequence)
    sizes += [1 << bit for bit in range(sequence.bit_length() - 1, -1, -1) if total % sequence >> bit & 1]
    room = np.array(sizes, np.int64)
    cost = np.zeros(len(sizes))
    filled = [0] * len(sizes)
    for length, doc, start in rest:
        while length:
            fits = room >= length
            if fits.any():
                place, part = int(np.argmin(np.where(fits, cost, np.inf))), length
            else:
                place = int(room.argmax())
                part = int(room[place])
            pieces.append((doc, start, part, opened + place, filled[place]))
            filled[place] += part
            room[place] -= part
            cost[place] += piece_cost(part, hidden)
            start += part
            length -= part
    return pieces


def packed_sequences(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, end_id: int = END_ID,
                     hidden: int = HIDDEN, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids): one row per piece.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit numbers.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    fields = ["start", "length", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(name, T.LongType()) for name in fields],
                           T.StructField("ids", T.BinaryType())])
    out_schema = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        first = TaskContext.get().partitionId() << PARTITION_BITS
        keys, texts, held, end = [], [], 0, np.array([end_id], "<u4").tobytes()

        def flush() -> pa.RecordBatch:
            nonlocal first, keys, texts, held
            lengths = [len(ids) // 4 for ids in texts]
            pieces = pack(lengths, sequence, hidden)
            doc, start, length, at, offset = (list(x) for x in zip(*pieces, strict=True))
            blobs = [texts[d][4 * s:4 * (s + n)] for d, s, n in zip(doc, start, length, strict=True)]
            batch = pa.RecordBatch.from_arrays([
                pa.concat_arrays(keys).take(pa.array(doc)), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                pa.array([lengths[d] for d in doc], pa.int64()), pa.array([first + s for s in at], pa.int64()),
                pa.array(offset, pa.int64()), pa.array(blobs, pa.binary())], schema=out_schema)
            first += max(at) + 1
            keys, texts, held = [], [], 0
            return batch

        for rows, _, _ in slices(batches, limit=1 << 20):
            keys.append(rows.column("doc_id"))
            found = tokenizer.ids([text or "" for text in rows.column("text").to_pylist()])
            texts += [ids + end for ids in found]
            held += sum(map(len, found)) // 4
            if held >= group_tokens:
                yield flush()
        if texts:
            yield flush()

    return docs.mapInArrow(run, schema)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"))


def piece_digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    pieces = packed_sequences(docs, str(public_tokenizers.path("word_bpe_49k.json")))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")
