"""N-grams of Arrow word lists, numbered so that strings are made for distinct ones only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SLICE_TOKENS = 1 << 20


def token_slices(batches: Iterator[pa.RecordBatch], tokens: str = "tokens",
                 limit: int = SLICE_TOKENS) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most ``limit`` tokens, one row at least."""
    for batch in batches:
        ends = np.cumsum(batch[tokens].value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + limit, "right")))
            yield batch.slice(low, high - low)
            low = high


def runs(counts: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n of ``counts``, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


class Spelling:
    """Strings of numbered n-grams, and hashes of them that are the same in every task."""

    def __init__(self, spelled: pa.Array, parts: list[np.ndarray]):
        self.spelled, self.parts = spelled, parts

    def __call__(self, numbers: np.ndarray) -> pa.Array:
        texts = [self.spelled.take(pa.array(p[numbers])) for p in self.parts]
        return texts[0] if len(texts) == 1 else pc.binary_join_element_wise(*texts, " ")

    def hashes(self, word_hashes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), np.uint64)
        for p in self.parts:
            out = (out ^ word_hashes[p[numbers]]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out


class Words:
    """Kept words of some papers: a number, the paper and the place in the whole word list of each."""

    def __init__(self, lists: pa.Array, stop: pa.Array):
        self.lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        words, self.paper = lists.flatten(), np.repeat(np.arange(len(lists)), self.lengths)
        self.place = runs(self.lengths)
        if len(stop):
            kept = pc.invert(pc.is_in(words, stop))
            words, kept = words.filter(kept), kept.to_numpy(zero_copy_only=False)
            self.paper, self.place = self.paper[kept], self.place[kept]
        coded = words.dictionary_encode()
        self.word, self.spelled = coded.indices.to_numpy().astype(np.int64), coded.dictionary

    def hashes(self) -> np.ndarray:
        """A hash of each distinct word."""
        return pd.util.hash_array(np.asarray(self.spelled.to_pylist(), object), categorize=False)

    def grams(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, Spelling]]:
        """(n, starts, numbers, distinct, spell) for n = 1 .. longest: n-grams within a paper.

        ``spell`` turns numbers into strings. An n-gram is numbered by the number of the one
        without its last word, and that word.
        """
        size = max(1, len(self.spelled))
        gram, parts = self.word, [np.arange(len(self.spelled))]
        for n in range(1, longest + 1):
            count = max(0, len(self.word) - n + 1)
            if n > 1:
                found, gram = np.unique(gram[:count] * size + self.word[n - 1:], return_inverse=True)
                parts = [p[found // size] for p in parts] + [found % size]
            starts = np.flatnonzero(self.paper[:count] == self.paper[n - 1:n - 1 + count])
            yield n, starts, gram[starts], max(1, len(parts[0])), Spelling(self.spelled, parts)
