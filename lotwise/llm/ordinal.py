"""Quality grades by cumulative-link ordinal regression on hashed text.

P(grade <= k) = sigmoid(threshold_k - score): one weight vector, shared by all
grades, over hashed words, hashed character n-grams of words and bucketed shape of
the text; thresholds are kept in order by construction. The result is the expected
grade and the probability of each grade or a better one, by which texts are kept.

The regression is fitted on at most about ``LABELLED`` rated texts outside the
held-out fold, chosen by a hash of doc_id.

Defined cases: a null text is empty; an empty text has shape features only; a null
grade is not used, and of several grades for one doc_id the lowest holds; repeated
rows are graded each; without any rating all grades are equally likely; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import char_model, vec
from lotwise.llm.common import fold_of, written

LABELLED = 6_000
BITS = 16
STEPS = 150
RATE = 0.1
RIDGE = 1e-4
KEEP_AT = 0.5
SHAPES = 64  # the last features of the space


def features(part: vec.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of every non-zero entry; the values of each kind have unit length per text."""
    space = (1 << BITS) - SHAPES
    words, hashes = vec.word_hashes(part)
    counts = np.bincount(words.rows, minlength=part.rows)
    rows, kinds, values = [], [], []

    def add(row: np.ndarray, feature: np.ndarray, times: np.ndarray) -> None:
        key, at = np.unique(row * (1 << BITS) + feature, return_inverse=True)
        value = np.log1p(np.bincount(at, weights=times))
        row = key >> BITS
        norm = np.sqrt(np.bincount(row, weights=value**2, minlength=part.rows))
        rows.append(row)
        kinds.append(key & ((1 << BITS) - 1))
        values.append(value / norm[row])

    if len(words):
        key = vec.mix(hashes ^ vec.mix(words.rows.astype(np.uint64)))
        _, first, times = np.unique(key, return_index=True, return_counts=True)
        own = words.rows[first]
        add(own, (hashes[first] % np.uint64(space)).astype(np.int64), times)
        points, before = vec.code_points(part)
        starts = before[words.starts[first]]
        packed, word = char_model.grams(char_model.classes(points), starts, before[words.ends[first]] - starts)
        gram = (vec.mix(packed.astype(np.uint64) + np.uint64(1 << 40)) % np.uint64(space)).astype(np.int64)
        add(own[word], gram, times[word])
        different = np.bincount(own, minlength=part.rows)
    else:
        different = counts
    # Length in powers of two, and the share of different words in eighths.
    length = np.minimum(np.log2(counts + 1).astype(np.int64), 31)
    share = np.where(counts > 0, different * 8 // np.maximum(counts, 1), 9)
    every = np.arange(part.rows)
    for place in (length, 32 + share):
        rows.append(every)
        kinds.append(space + place)
        values.append(np.ones(part.rows))
    rows, kinds, values = (np.concatenate(x) for x in (rows, kinds, values))
    order = np.argsort(rows, kind="stable")
    return rows[order], kinds[order], values[order]


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray  # grades - 1 of them, increasing

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, a column each."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -30, 30)))


def fit(rows: np.ndarray, kinds: np.ndarray, values: np.ndarray, grades: np.ndarray, n_grades: int) -> Ordinal:
    """Maximum likelihood with a ridge, by Adam over all texts at once."""
    cuts = n_grades - 1
    first = np.array([np.clip((grades <= k).mean() if len(grades) else (k + 1) / n_grades, 0.01, 0.99) for k in range(cuts)])
    first = np.maximum.accumulate(np.log(first / (1 - first)) + 1e-3 * np.arange(cuts))
    gaps = np.log(np.maximum(np.diff(first), 1e-3))
    packed = np.concatenate([np.zeros(1 << BITS), first[:1], gaps])
    if not len(grades):
        return Ordinal(packed[: 1 << BITS], first)
    mean, square = np.zeros_like(packed), np.zeros_like(packed)

    def thresholds() -> np.ndarray:
        return packed[1 << BITS] + np.concatenate([[0], np.cumsum(np.exp(packed[(1 << BITS) + 1 :]))])

    n = len(grades)
    for step in range(1, STEPS + 1):
        weights, theta = packed[: 1 << BITS], thresholds()
        score = np.bincount(rows, weights=values * weights[kinds], minlength=n)
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        below = 1 / (1 + np.exp(-np.clip(edges[grades + 1] - score, -30, 30)))
        under = 1 / (1 + np.exp(-np.clip(edges[grades] - score, -30, 30)))
        below[grades == cuts], under[grades == 0] = 1.0, 0.0
        chance = np.maximum(below - under, 1e-12)
        slope_high, slope_low = below * (1 - below) / chance, under * (1 - under) / chance
        by_score = (slope_high - slope_low) / n  # of the negative log-likelihood
        slope = np.bincount(kinds, weights=values * by_score[rows], minlength=1 << BITS) + RIDGE * weights
        by_theta = np.zeros(cuts)
        np.add.at(by_theta, grades[grades < cuts], -slope_high[grades < cuts] / n)
        np.add.at(by_theta, grades[grades > 0] - 1, slope_low[grades > 0] / n)
        later = np.cumsum(by_theta[::-1])[::-1]
        gradient = np.concatenate([slope, later[:1], later[1:] * np.exp(packed[(1 << BITS) + 1 :])])
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        packed = packed - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Ordinal(packed[: 1 << BITS].copy(), thresholds())


def rated(docs: DataFrame, ratings: DataFrame, bound: int = LABELLED) -> DataFrame:
    """About ``bound`` rated texts outside the held-out fold: doc_id, text, grade."""
    usable = (
        ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade"))
        .filter(F.col("doc_id").isNotNull() & F.col("grade").isNotNull() & (fold_of(F.col("doc_id")) != 1))
        .groupBy("doc_id")
        .agg(F.min("grade").alias("grade"))
    )
    usable = written(usable, "ratings")
    share = min(1.0, bound / max(usable.count(), 1))
    # At most about ``bound`` rows of two numbers, so this side may go to every task.
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(share * 1_000_003) + (share == 1.0))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(chosen), "doc_id")


def train(sample: DataFrame, n_grades: int) -> Ordinal:
    """Fit on the bounded sample; its sparse features come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vec.slices(batch.column("text")):
                rows, kinds, values = features(part)
                edges = np.searchsorted(rows, np.arange(part.rows + 1)).astype(np.int32)
                some = batch.slice(part.first, part.rows)
                lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x)) for x in
                         (kinds.astype(np.int32), values.astype(np.float32))]
                columns = [some.column("doc_id"), some.column("grade"), *lists]
                yield pa.record_batch(columns, ["doc_id", "grade", "kinds", "values"])

    got = sample.mapInArrow(run, "doc_id long, grade int, kinds array<int>, values array<float>").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("grade", "ascending")]).combine_chunks()
    sizes = got.column("kinds").combine_chunks().value_lengths().to_numpy()
    kinds = got.column("kinds").combine_chunks().flatten().to_numpy().astype(np.int64)
    values = got.column("values").combine_chunks().flatten().to_numpy().astype(float)
    grades = np.clip(got.column("grade").to_numpy(), 0, n_grades - 1).astype(np.int64)
    return fit(np.repeat(np.arange(len(sizes)), sizes), kinds, values, grades, n_grades)


def grade(docs: DataFrame, ratings: DataFrame, n_grades: int, keep_at: float = KEEP_AT) -> DataFrame:
    """Expected grade of every document (doc_id, text), its tail probabilities, and whether it is kept.

    ``ratings`` has doc_id and grade from 0; a text is kept when the probability of
    any grade above the lowest is at least ``keep_at``.
    """
    model = train(rated(docs, ratings), n_grades)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"p_ge_{k}" for k in range(1, n_grades)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vec.slices(batch.column("text")):
                rows, kinds, values = features(part)
                scores = np.bincount(rows, weights=values * sent.value.weights[kinds], minlength=part.rows)
                tails = sent.value.tails(scores)
                columns = [batch.column("doc_id").slice(part.first, part.rows), pa.array(tails.sum(1))]
                yield pa.record_batch([*columns, *map(pa.array, tails.T)], ["doc_id", "expected_grade", *names])

    schema = "doc_id long, expected_grade double, " + ", ".join(f"{n} double" for n in names)
    graded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    return graded.withColumn("held_out", F.coalesce(fold_of(F.col("doc_id")) == 1, F.lit(False))).withColumn(
        "kept", F.col("p_ge_1") >= keep_at
    )
