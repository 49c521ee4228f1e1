"""Character n-gram model of words: Spark counts, modified Kneser-Ney, sorted hash arrays.

Code points fall into 64 classes and an n-gram of up to four classes is hashed into
24 bits without a collision, so the model has at most 2 ** 24 entries per order
whatever the corpus: 128 MB at worst in its largest array, and that bound is what
allows it to be collected and sent to every task. Words are padded with the
boundary class, contexts do not cross words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import vec

ORDER = 4
BITS = 6
BOUNDARY = 1
_MASK = [(1 << (BITS * k)) - 1 for k in range(ORDER + 1)]


def _classes() -> np.ndarray:
    table = np.full(128, 56, np.uint32)
    table[ord("a") : ord("z") + 1] = np.arange(2, 28)
    table[ord("A") : ord("Z") + 1] = np.arange(28, 54)
    table[ord("0") : ord("9") + 1] = 54
    for mark in ".,;:!?":
        table[ord(mark)] = 55
    return table


_ASCII = _classes()


def classes(points: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """Class of each code point: letters, digits, marks, other ASCII; the rest is hashed into seven."""
    got = np.where(points < 128, _ASCII[np.minimum(points, 127)], 57 + points % 7).astype(np.uint32)
    if fold_case:
        got = np.where((got >= 28) & (got < 54), got - 26, got)
    return got


def grams(kinds: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of words given as runs of ``kinds``, and the word each belongs to.

    A word of n characters has n + 1: one for every character and one for its end.
    """
    sizes = lengths + 1
    word = np.repeat(np.arange(len(starts)), sizes)
    at = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    start, length = starts[word], lengths[word]
    packed = np.zeros(len(word), np.uint32)
    for back in range(ORDER):
        place = at - back
        inside = (place >= 0) & (place < length)
        kind = np.where(inside, kinds[np.minimum(start + np.maximum(place, 0), max(len(kinds) - 1, 0))], BOUNDARY)
        packed |= kind.astype(np.uint32) << np.uint32(BITS * back)
    return packed, word


def distinct_words(part: vec.Slice) -> tuple[vec.Spans, np.ndarray, np.ndarray]:
    """Words of a slice, the index of one word of each kind, and the kind of every word."""
    words, hashes = vec.word_hashes(part)
    _, first, kind = np.unique(hashes, return_index=True, return_inverse=True)
    return words, first, kind


def word_grams(part: vec.Slice, words: vec.Spans, chosen: np.ndarray, fold_case: bool):
    points, before = vec.code_points(part)
    starts = before[words.starts[chosen]]
    lengths = before[words.ends[chosen]] - starts
    return grams(classes(points, fold_case), starts, lengths)


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, weights=counts, minlength=len(keys)).astype(np.int64)


def _counter(fold_case: bool):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for batch in batches:
            for part in vec.slices(batch.column(0)):
                words, first, kind = distinct_words(part)
                if not len(words):
                    continue
                packed, word = word_grams(part, words, first, fold_case)
                more = merged(packed, np.bincount(kind, minlength=len(first))[word])
                keys, counts = merged(np.concatenate([keys, more[0]]), np.concatenate([counts, more[1]]))
        yield pa.record_batch({"gram": pa.array(keys.astype(np.int32)), "n": pa.array(counts)})

    return count


def gram_counts(texts: DataFrame, fold_case: bool = False) -> DataFrame:
    """Occurrences of every n-gram in all words of the one text column: gram, n."""
    partial = texts.mapInArrow(_counter(fold_case), "gram int, n long")
    return partial.groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class CharModel:
    """Probabilities by order in sorted arrays; unseen n-grams back off."""

    keys: list[np.ndarray]  # by order, 1 first
    logs: list[np.ndarray]
    contexts: list[np.ndarray]  # contexts of the order, sorted
    backoffs: list[np.ndarray]  # log weight that the context leaves to the next lower order

    def log_prob(self, packed: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each n-gram's last class."""
        out = np.zeros(len(packed))
        open_ = np.arange(len(packed))
        for order in range(ORDER, 0, -1):
            want = packed[open_] & np.uint32(_MASK[order])
            at, hit = _find(self.keys[order - 1], want)
            out[open_[hit]] += self.logs[order - 1][at[hit]]
            open_, want = open_[~hit], want[~hit]
            if not len(open_):
                return out
            at, known = _find(self.contexts[order - 1], want >> np.uint32(BITS))
            out[open_[known]] += self.backoffs[order - 1][at[known]]
        out[open_] -= BITS * np.log(2)
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more.

    Where a count of counts is missing (small corpora) the usual constants stand in.
    """
    n1, n2, n3, n4 = (int((counts == k).sum()) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return np.array([0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0.05] * 3, [0.95, 1.95, 2.95])


def estimate(keys: np.ndarray, counts: np.ndarray) -> CharModel:
    """Interpolated modified Kneser-Ney from the counts of the highest order."""
    tables = {ORDER: (keys, counts)}
    for order in range(ORDER - 1, 0, -1):
        tables[order] = np.unique(tables[order + 1][0] & np.uint32(_MASK[order]), return_counts=True)
    model = CharModel([], [], [], [])
    lower = np.zeros(0)
    for order in range(1, ORDER + 1):
        keys, counts = tables[order]
        cut = discounts(counts)
        contexts, at = np.unique(keys >> np.uint32(BITS), return_inverse=True)
        total = np.bincount(at, weights=counts)
        taken = cut[np.minimum(counts, 3) - 1]
        left = np.bincount(at, weights=taken) / np.maximum(total, 1)
        if order == 1:
            below = np.full(len(keys), 1 / (1 << BITS))
        else:
            below = lower[np.searchsorted(tables[order - 1][0], keys & np.uint32(_MASK[order - 1]))]
        lower = (counts - taken) / total[at] + left[at] * below
        model.keys.append(keys)
        model.logs.append(np.log(lower).astype(np.float32))
        model.contexts.append(contexts)
        model.backoffs.append(np.log(left).astype(np.float32))
    return model


def train(texts: DataFrame, fold_case: bool = False) -> CharModel:
    """Count over all texts on Spark, then estimate; only the bounded counts reach the driver."""
    got = gram_counts(texts, fold_case).toArrow()
    keys = got.column("gram").to_numpy().astype(np.uint32)
    order = np.argsort(keys)
    return estimate(keys[order], got.column("n").to_numpy()[order])
