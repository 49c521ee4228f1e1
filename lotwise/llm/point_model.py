"""Code-point n-gram model of words: Spark counts, modified Kneser-Ney by DataFrame aggregation.

N-grams are runs of code points, so the model has no fixed alphabet and grows with
the corpus. As is usual before perplexity, ASCII digits count as one digit, the
marks of sentences as one and other ASCII marks as one (``normalised``); all else
is itself. Words are padded with a mark outside Unicode, contexts do not
cross words. Counts, discounts, contexts and probabilities are Spark aggregations
and joins; the model is a table of 64-bit hashed n-grams with their costs, written
partitioned and sorted by hash.

Only n-grams that make at least one in ``limit`` of all occurrences are sent to
tasks, as two sorted arrays. No more than ``limit`` n-grams can be that frequent,
whatever the corpus; all others are looked up by a join, in which none of them
is a hot key.

A cost is a negative log-probability in whole millionths of a nat, so that sums do
not depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import vec
from lotwise.llm.common import discard, written

ORDER = 4
BOUNDARY = 0x110000  # one above the last code point
SYMBOLS = BOUNDARY + 1
UNIT = 1_000_000  # costs in a nat
FREQUENT = 1 << 20
HELD = 1 << 20  # n-grams a counting task holds before it hands them on
POINTS = [f"p{k}" for k in range(ORDER)]  # oldest first


def _table() -> np.ndarray:
    table = np.full(128, ord("#"), np.int32)
    for first, last in ("az", "AZ"):
        table[ord(first) : ord(last) + 1] = np.arange(ord(first), ord(last) + 1)
    table[ord("0") : ord("9") + 1] = ord("0")
    table[[ord(mark) for mark in ".,;:!?"]] = ord(".")
    return table


_ASCII = _table()


def normalised(points: np.ndarray) -> np.ndarray:
    """Code points with digits, marks of sentences and other ASCII marks made one each."""
    return np.where(points < 128, _ASCII[np.minimum(points, 127)], points.astype(np.int32))


def grams(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of the n-grams of words given as runs of ``points``, and the word each belongs to.

    A word of n characters has n + 1: one for every character and one for its end.
    """
    sizes = lengths + 1
    word = np.repeat(np.arange(len(starts)), sizes)
    at = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    start, length = starts[word], lengths[word]
    columns = []
    for back in range(ORDER - 1, -1, -1):
        place = at - back
        inside = (place >= 0) & (place < length)
        column = points[np.minimum(start + np.maximum(place, 0), len(points) - 1)].astype(np.int32)
        columns.append(np.where(inside, column, BOUNDARY).astype(np.int32))
    return columns, word


def keys(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of each n-gram."""
    out = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        out = vec.mix((out ^ column.astype(np.uint64)) + np.uint64(vec._BASE))
    return out.view(np.int64)


def _merged(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """One entry for each n-gram; ``columns`` starts with its hash."""
    _, first, at = np.unique(columns[0], return_index=True, return_inverse=True)
    return [c[first] for c in columns], np.bincount(at, weights=counts, minlength=len(first)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", *POINTS, "n"]
    held = None
    for batch in batches:
        for part in vec.slices(batch.column(0)):
            words, hashes = vec.word_hashes(part)
            if not len(words):
                continue
            _, first, kind = np.unique(hashes, return_index=True, return_inverse=True)
            points, before = vec.code_points(part)
            starts = before[words.starts[first]]
            columns, word = grams(normalised(points), starts, before[words.ends[first]] - starts)
            more = _merged([keys(columns), *columns], np.bincount(kind, minlength=len(first))[word])
            if held is None:
                held = more
            else:
                joined = [np.concatenate(pair) for pair in zip(held[0], more[0])]
                held = _merged(joined, np.concatenate([held[1], more[1]]))
            if len(held[1]) > HELD:
                yield pa.record_batch([pa.array(c) for c in (*held[0], held[1])], names)
                held = None
    if held is not None:
        yield pa.record_batch([pa.array(c) for c in (*held[0], held[1])], names)


def counts(texts: DataFrame) -> DataFrame:
    """Occurrences of every n-gram in all words of the one text column."""
    fields = ", ".join(f"{p} int" for p in POINTS)
    return texts.mapInArrow(_count, f"key long, {fields}, n long").groupBy("key", *POINTS).agg(F.sum("n").alias("n"))


def _discounts(table: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more.

    Where a count of counts is missing (small corpora) the usual constants stand in.
    """
    n1, n2, n3, n4 = table.agg(*[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]).first()
    if not (n1 and n2 and n3 and n4):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), most) for d, most in zip(raw, (0.95, 1.95, 2.95))]


def _interpolated(table: DataFrame, names: list[str], lower: DataFrame | None) -> DataFrame:
    """Probability ``p`` of the last code point of each n-gram, given the others."""
    cut = _discounts(table)
    n = F.col("n")
    by_count = [F.count_if(n == 1), F.count_if(n == 2), F.count_if(n > 2)]
    taken = F.when(n == 1, cut[0]).when(n == 2, cut[1]).otherwise(cut[2])
    left = sum((F.lit(d) * c for d, c in zip(cut, by_count)), F.lit(0.0))
    context = [F.sum("n").alias("_total"), left.alias("_left")]
    if lower is None:
        total, rest = table.agg(*context).first()
        return table.withColumn("p", (n - taken) / F.lit(total) + F.lit((rest or 0.0) / (total or 1) / SYMBOLS))
    below = lower.select(*names[1:], F.col("p").alias("_below"))
    return (
        table.join(table.groupBy(*names[:-1]).agg(*context), names[:-1])
        .join(below, names[1:])
        .withColumn("p", (n - taken + F.col("_left") * F.col("_below")) / F.col("_total"))
        .drop("_total", "_left", "_below")
    )


def estimate(counted: DataFrame) -> DataFrame:
    """Cost and occurrences of every counted n-gram: key, cost, n."""
    tables = {ORDER: written(counted, "ngrams")}
    for order in range(ORDER - 1, 0, -1):
        followed = tables[order + 1].groupBy(*POINTS[-order:]).agg(F.count("*").alias("n"))
        tables[order] = written(followed, "ngrams")
    lower = None
    for order in range(1, ORDER + 1):
        lower = _interpolated(tables[order], POINTS[-order:], lower)
    cost = F.round(F.log("p") * -UNIT).cast("long")
    # Two n-grams of one hash, if ever, share the lower cost.
    model = lower.groupBy("key").agg(F.min(cost).alias("cost"), F.sum("n").alias("n")).sortWithinPartitions("key")
    model = written(model, "ngram-model")
    discard(*tables.values())
    return model


@dataclass
class Frequent:
    """The frequent n-grams: sorted hashes, and their costs."""

    keys: np.ndarray
    costs: np.ndarray

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost of each wanted n-gram, 0 if it isn't here, and whether it is."""
        if not len(self.keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = self.keys[at] == wanted
        return np.where(hit, self.costs[at], 0), hit


def frequent(model: DataFrame, limit: int = FREQUENT) -> Frequent:
    """N-grams of at least one in ``limit`` occurrences; at most ``limit`` of them exist."""
    total = model.agg(F.sum("n")).first()[0] or 0
    got = model.filter(F.col("n").cast("decimal(38,0)") * limit >= F.lit(total)).select("key", "cost").toArrow()
    found = got.column("key").to_numpy()
    order = np.argsort(found)
    return Frequent(found[order], got.column("cost").to_numpy()[order])
