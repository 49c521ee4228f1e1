"""Importance resampling of documents towards a target distribution.

Documents and target texts are bags of hashed word n-grams. A bucket's gain is the
log-ratio of its smoothed shares in target and documents, kept in an array that
scores texts; a document's weight is the mean gain of its features. Adding Gumbel
noise to the weights and taking the highest scores draws without replacement in
proportion to the exponential of the weights.

The order is a distributed LSD radix sort. Rows carry a position; a pass counts the
digits of every block of positions, turns the counts into global offsets by prefix
sums (digits first, blocks within a digit), and gives each row the offset of its
digit and block plus its place there, which is the row's new position. Passes go from
the least significant digit of the last key to the most significant of the first,
and digits that are equal in all rows are left out. No task sees more than one
block of a digit, so equal or frequent keys do not gather anywhere.

Defined cases: null and empty texts have no features and weight 0, and too few words
to be drawn; a null doc_id is hashed as the empty string and comes after all others
of its score; repeated rows are rows of their own (ties between rows that are equal
in score and doc_id may go either way, with equal results); other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm import vec
from lotwise.llm.common import discard, written

BUCKETS = 10_000
LEAST_WORDS = 20
SHARE = 25  # per cent of the documents long enough that are drawn
SEED = 7
DIGIT_BITS = 12
BLOCK_BITS = (10, 18)  # rows of a block as powers of two, least and most
BLOCKS = 4096  # that the table is cut into where these allow
LONG = 64  # bytes; longer words are hashed one by one

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SEPARATOR = np.zeros(256, bool)
for first, last in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    SEPARATOR[first : last + 1] = True


def _crc_table() -> np.ndarray:
    """The remainders of all bytes under the reversed CRC-32 polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return table


_CRC = _crc_table()
_ONE_BYTE = np.uint32(0xFF)


def _step(state: np.ndarray, byte) -> np.ndarray:
    return _CRC[(state ^ byte) & _ONE_BYTE] ^ (state >> np.uint32(8))


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of many byte spans at once, each going on from the value of the bytes before it."""
    values = np.zeros(len(starts), np.uint32) if values is None else values
    sizes = np.minimum(ends - starts, LONG + 1)
    order = np.argsort(sizes.astype(np.uint8), kind="stable")[::-1]
    at, state = starts[order], ~values[order]
    longer = len(sizes) - np.cumsum(np.bincount(sizes, minlength=LONG + 2))
    for k in range(LONG):
        n = int(longer[k])  # spans of more than k bytes stand in front
        if not n:
            break
        state[:n] = _step(state[:n], data[at[:n] + k])
    out = np.empty_like(state)
    out[order] = ~state
    for i in np.flatnonzero(sizes > LONG):
        out[i] = zlib.crc32(data[starts[i] : ends[i]], int(values[i]))
    return out


@dataclass
class Features:
    words: np.ndarray  # number in each text
    buckets: np.ndarray
    rows: np.ndarray  # text of each bucket


def features(part: vec.Slice) -> Features:
    """Buckets of all words and pairs of neighbouring words of a slice."""
    part = vec.Slice(part.first, LOWER[part.data], part.offsets)
    words = vec.spans(part, SEPARATOR)
    single = crc32(part.data, words.starts, words.ends)
    follows = np.flatnonzero(words.rows[1:] == words.rows[:-1])
    spaced = ~_step(~single[follows], np.uint32(0x20))
    double = crc32(part.data, words.starts[follows + 1], words.ends[follows + 1], spaced)
    buckets = (np.concatenate([single, double]) % np.uint32(BUCKETS)).astype(np.int64)
    rows = np.concatenate([words.rows, words.rows[follows]])
    return Features(np.bincount(words.rows, minlength=part.rows), buckets, rows)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features in each bucket over all texts: an array of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in vec.slices(batch.column("text")):
                total += np.bincount(features(part).buckets, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    counted = texts.select("text").mapInArrow(run, "bucket long, n long")
    got = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousand times the log-ratio of smoothed shares, rounded down, of each bucket."""
    all_documents = float(documents.sum() + BUCKETS)
    all_target = float(target.sum() + BUCKETS)
    ratios = (target + 1.0) * all_documents / ((documents + 1.0) * all_target)
    return np.array([math.floor(1000 * math.log(r)) for r in ratios.tolist()], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    names = ["doc_id", "n_words", "n_features", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vec.slices(batch.column("text")):
                found = features(part)
                n = np.bincount(found.rows, minlength=part.rows)
                total = np.zeros(part.rows, np.int64)
                np.add.at(total, found.rows, sent.value[found.buckets])
                columns = [pa.array(c) for c in (found.words, n, total // np.maximum(n, 1))]
                yield pa.record_batch([batch.column("doc_id").slice(part.first, part.rows), *columns], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, ", ".join(f"{name} long" for name in names))


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousand times a Gumbel deviate that the seed and the id determine, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _digits(key: str, varying: int) -> list[tuple[str, int, int]]:
    """(key, lowest bit, bits) of the digits that differ between rows, least significant first."""
    out = []
    low = 0
    while varying >> low:
        if varying >> low & 1:
            width = min(DIGIT_BITS, 64 - low)
            out.append((key, low, width))
            low += width
        else:
            low += 1
    return out


def _pass(rows: DataFrame, key: str, low: int, width: int, bits: int) -> DataFrame:
    """One stable counting sort: new positions by a digit of ``key``."""
    digit = F.expr(f"cast(shiftrightunsigned({key}, {low}) & {(1 << width) - 1} as int)")
    rows = rows.withColumn("digit", digit).withColumn("block", F.shiftright("position", bits))
    counts = rows.groupBy("digit", "block").agg(F.count("*").alias("n"))
    # At most 2 ** DIGIT_BITS rows, whatever the table.
    digits = counts.groupBy("digit").agg(F.sum("n").alias("all"))
    before = F.sum("all").over(Window.orderBy("digit")) - F.col("all")
    digits = digits.select(F.col("digit"), before.alias("before"))
    earlier = F.sum("n").over(Window.partitionBy("digit").orderBy("block")) - F.col("n")
    offsets = counts.withColumn("earlier", earlier).join(digits, "digit")
    offsets = offsets.select("digit", "block", (F.col("before") + F.col("earlier")).alias("offset"))
    place = F.row_number().over(Window.partitionBy("digit", "block").orderBy("position")) - 1
    moved = rows.withColumn("place", place).join(offsets, ["digit", "block"])
    return moved.withColumn("position", F.col("offset") + F.col("place")).drop("digit", "block", "offset", "place")


def radix_sort(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with ``position``, from 0 in the order of ``keys``, which are longs taken as unsigned.

    ``rows`` must be a written table, whose rows keep the positions they are given first.
    """
    span = [f(key) for key in keys for f in (F.bit_or, F.bit_and)]
    n, *span = rows.agg(F.count("*"), *span).first()
    if not n:
        return rows.withColumn("position", F.lit(0).cast("long"))
    bits = min(max((n // BLOCKS).bit_length(), BLOCK_BITS[0]), BLOCK_BITS[1])
    varying = {key: (span[2 * k] ^ span[2 * k + 1]) & (1 << 64) - 1 for k, key in enumerate(keys)}
    digits = [d for key in reversed(keys) for d in _digits(key, varying[key])] or [(keys[0], 0, 1)]
    state = written(rows.withColumn("position", F.monotonically_increasing_id()), "radix")
    for digit in digits:
        before, state = state, written(_pass(state, *digit, bits), "radix")
        discard(before)
    return state


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; undrawn ones have no rank.

    ``docs`` has doc_id and text, ``target`` text. Of the N documents with at least
    ``LEAST_WORDS`` words, floor(share * N / 100) are drawn.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = weigh(docs, gain)
    score = F.col("weight") + gumbel(F.col("doc_id"), seed)
    scored = written(scored.withColumn("score", score), "scored")
    able = scored.filter(F.col("n_words") >= LEAST_WORDS)
    n, highest = able.agg(F.count("*"), F.max("score")).first()
    # Unsigned keys: high scores first, then ids with the sign bit turned, nulls last.
    turned = F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))
    keys = able.select(
        "*",
        (F.lit(highest).cast("long") - F.col("score")).alias("fall"),
        F.col("doc_id").isNull().cast("long").alias("unnamed"),
        F.coalesce(turned, F.lit(0).cast("long")).alias("turned"),
    )
    names = ["doc_id", "n_features", "weight", "score"]
    rank = F.when(F.col("position") < share * n // 100, F.col("position") + 1)
    sorted_rows = radix_sort(keys, ["fall", "unnamed", "turned"]).select(*names, rank.cast("long").alias("rank"))
    short = scored.filter(F.col("n_words") < LEAST_WORDS)
    return sorted_rows.unionByName(short.select(*names, F.lit(None).cast("long").alias("rank")))
