"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared in lower case with white space as single blanks.
An item of m characters allows ``k = int(m * BUDGET)`` edits. It is cut into
k + 1 pieces: a passage within k edits of the item holds at least one piece
unchanged. An item too short for any edit is its only piece, and must stand in the
text as it is, from word boundary to word boundary. An automaton of all pieces finds every exact hit in a text; around each
hit the item is verified with Myers' bit-parallel edit distance. The result is
exact: every place where an item occurs within its budget is found.

Items go to the tasks in blocks of at most ``BLOCK_CHARS`` characters, each block
against all documents, so what a task holds is bounded however many items there are.

Defined cases: null texts are empty; null or blank items match nothing; items with
equal normal form are each reported; an item too short for its pieces (k + 1
characters) is compared at every place; repeated rows are each searched; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import vec
from lotwise.llm.common import written

BUDGET = 0.08
BLOCK_CHARS = 1 << 20

MATCHES = "doc_id long, item_id long, distance int, begin long, end long"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget_of(length: int, share: float = BUDGET) -> int:
    return int(length * share)


def whole_words(pattern: str, text: str, begin: int, end: int) -> int:
    """Where a pattern first stands in ``text[begin:end]`` without a letter or digit going on at its ends; else -1."""
    at = text.find(pattern, begin, end)
    while at >= 0:
        stop = at + len(pattern)
        before = at > 0 and text[at - 1].isalnum() and pattern[0].isalnum()
        after = stop < len(text) and text[stop].isalnum() and pattern[-1].isalnum()
        if not before and not after:
            return at
        at = text.find(pattern, at + 1, end)
    return -1


def cuts(length: int, pieces: int) -> list[int]:
    return [length * p // pieces for p in range(pieces + 1)]


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Smallest edit distance of a pattern to any passage of ``text``, and where the first such passage ends.

    One step a character on vertical differences kept in two integers of m bits.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    positive, negative, score = full, 0, m
    best, end = m, 0
    for at, char in enumerate(text):
        equal = masks.get(char, 0)
        vertical = equal | negative
        horizontal = (((equal & positive) + positive) ^ positive) | equal
        up = negative | ~(horizontal | positive) & full
        down = positive & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        if score < best:
            best, end = score, at + 1
        up, down = (up << 1) & full, (down << 1) & full
        positive = down | ~(vertical | up) & full
        negative = up & vertical
    return best, end


def masks_of(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for at, char in enumerate(pattern):
        masks[char] = masks.get(char, 0) | 1 << at
    return masks


class Matcher:
    """All items of one block."""

    def __init__(self, items: list[tuple[int, str]], share: float):
        self.items = [(item, normal(text)) for item, text in items]
        self.items = [(item, text) for item, text in self.items if text]
        self.budget = [budget_of(len(t), share) for _, t in self.items]
        self.masks = [masks_of(t) for _, t in self.items]
        self.short = []
        places: dict[str, list[tuple[int, int]]] = {}
        for index, (_, text) in enumerate(self.items):
            edges = cuts(len(text), self.budget[index] + 1)
            if any(a == b for a, b in zip(edges, edges[1:])):
                self.short.append(index)
                continue
            for a, b in zip(edges, edges[1:]):
                places.setdefault(text[a:b], []).append((index, a))
        self.pieces = ahocorasick.Automaton()
        for piece, found in places.items():
            self.pieces.add_word(piece, (len(piece), found))
        if places:
            self.pieces.make_automaton()
        self.empty = not places

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """By item, the joined stretches of the text in which it can lie."""
        spans: dict[int, list[list[int]]] = {i: [[0, len(text)]] for i in self.short}
        hits: dict[int, set[int]] = {}
        if not self.empty:
            for last, (length, found) in self.pieces.iter(text):
                for index, offset in found:
                    hits.setdefault(index, set()).add(last + 1 - length - offset)
        for index, starts in hits.items():
            k, m = self.budget[index], len(self.items[index][1])
            joined: list[list[int]] = []
            for start in sorted(starts):
                # The passage starts up to k before or after the place the piece implies.
                begin, end = max(0, start - k), min(len(text), start + m + k)
                if joined and begin <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], end)
                else:
                    joined.append([begin, end])
            spans[index] = joined
        return spans

    def match(self, text: str) -> list[tuple[int, int, int, int]]:
        """item_id, smallest distance, and the stretch of the normal text searched up to the passage's end."""
        text, out = normal(text), []
        for index, stretches in self.windows(text).items():
            item, pattern = self.items[index]
            best = None
            for begin, end in stretches:
                if not self.budget[index]:
                    at = whole_words(pattern, text, begin, end)
                    if at < 0:
                        continue
                    distance, stop = 0, at + len(pattern) - begin
                elif text.find(pattern, begin, end) >= 0:
                    distance, stop = 0, text.find(pattern, begin, end) + len(pattern) - begin
                else:
                    distance, stop = myers(self.masks[index], len(pattern), text[begin:end])
                if distance <= self.budget[index] and (best is None or distance < best[0]):
                    best = (distance, max(begin, begin + stop - len(pattern)), begin + stop)
            if best:
                out.append((item, *best))
        return out


@lru_cache(maxsize=2)
def _matcher(items: tuple, share: float) -> Matcher:
    return Matcher(list(items), share)


def _blocks(benchmark: DataFrame) -> Iterator[tuple]:
    """Items in blocks of bounded size; one block at a time comes to the driver."""
    size = F.length("text").cast("long")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    items = items.withColumn("bucket", F.pmod(F.xxhash64("item_id", "text"), F.lit(1 << 20)))
    buckets = items.groupBy("bucket").agg(F.sum(size).alias("size"))
    total = buckets.agg(F.sum("size")).first()[0] or 0
    if total <= BLOCK_CHARS:
        yield tuple((r["item_id"], r["text"]) for r in items.orderBy("item_id", "text").collect())
        return
    items = written(items, "benchmark-items")
    count = -(-total // (BLOCK_CHARS // 2))
    for block in range(count):
        chosen = items.filter(F.col("bucket") % count == block).orderBy("item_id", "text")
        yield tuple((r["item_id"], r["text"]) for r in chosen.collect())


def matches(docs: DataFrame, benchmark: DataFrame, share: float = BUDGET) -> DataFrame:
    """Every document and item that occurs in it within its budget: the smallest distance and its place.

    Places count characters of the normal text: ``end`` is where the closest passage
    ends, ``begin`` lies the item's length before it. ``docs`` needs doc_id and text,
    ``benchmark`` item_id and text.
    """
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    result, first = None, True
    for items in _blocks(benchmark):
        sent = context.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(sent.value, share)
            for batch in batches:
                ids, rows = batch.column("doc_id").to_pylist(), []
                for part in vec.slices(batch.column("text")):
                    for row, (a, b) in enumerate(zip(part.offsets[:-1], part.offsets[1:])):
                        rows += [(ids[part.first + row], *m) for m in matcher.match(part.text(a, b))]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.record_batch(columns, ["doc_id", "item_id", "distance", "begin", "end"])

        found = texts.mapInArrow(run, MATCHES)
        result = found if first else result.unionByName(found)
        first = False
    return result


def clean(docs: DataFrame, benchmark: DataFrame, share: float = BUDGET) -> DataFrame:
    """Documents without any passage of the benchmark, with all their columns."""
    context = docs.sparkSession.sparkContext
    kept = docs
    for items in _blocks(benchmark):
        sent = context.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(sent.value, share)
            for batch in batches:
                for part in vec.slices(batch.column("text")):
                    spans = zip(part.offsets[:-1], part.offsets[1:])
                    pure = [not matcher.match(part.text(a, b)) for a, b in spans]
                    yield batch.slice(part.first, part.rows).filter(pa.array(pure, pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
