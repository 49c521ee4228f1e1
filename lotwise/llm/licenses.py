"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

A block is a line with at least one word, a template a known notice; both count as
sets of words. A block meets a template when it holds at least ``CONTAINMENT`` of the
template's words. Words are ordered by how often they occur in the whole corpus,
rarest first. Then, for a template of t words that needs r of them:

* prefix: a block that meets it holds one of its first t - r + 1 words;
* length: the block has at least r words;
* position: if the first word of the template that the block holds is at place p
  (from 0), at most t - p words can be shared, so t - p must be at least r.

What passes is counted exactly, so every block that meets a template is found.

A notice can be wrapped over lines. With ``wrapped``, passages count as well: windows
of successive words across line ends, a little longer than the template (its words
over ``CONTAINMENT``). Only windows around a prefix word are looked at, by the same
three filters. Of overlapping windows that meet a template the best is reported, with
the line it begins on, unless a line within them meets the template by itself.

Templates go to the tasks in batches of at most ``BATCH_WORDS`` words.

Defined cases: a null text is empty and has no blocks; templates without words meet
nothing; repeated rows are scanned each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import vec

CONTAINMENT = 0.9
BATCH_WORDS = 1 << 18

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Openings of public license notices.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance"
     " with the License. You may obtain a copy of the License at"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
     " General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
     " associated documentation files, to deal in the Software without restriction"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"
     " provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 256)]] = False

SCANNED = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string,"
    " labels string, score double, blocks array<struct<line:int,label:string,containment:double>>"
)


def _words(part: vec.Slice) -> tuple[vec.Spans, np.ndarray]:
    """Words of a slice after lower-casing A-Z, and their hashes."""
    lower = vec.Slice(part.first, _LOWER[part.data], part.offsets)
    words = vec.spans(lower, _SEPARATOR)
    return words, vec.span_hash(vec.byte_hash(lower.data), words.starts, words.ends)


def hashes_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return _words(vec.Slice(0, data, np.array([0, len(data)])))[1]


def vocabulary(templates: list[tuple[str, str]]) -> np.ndarray:
    return np.unique(np.concatenate([hashes_of(text) for _, text in templates] or [np.zeros(0, np.uint64)]))


def frequencies(docs: DataFrame, words: np.ndarray) -> np.ndarray:
    """Occurrences of each of the sorted ``words`` in all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = sent.value, np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for part in vec.slices(batch.column(0)):
                at = _place(known, _words(part)[1])
                total += np.bincount(at[at >= 0], minlength=len(known))
        yield pa.record_batch([pa.array(np.arange(len(known), dtype=np.int32)), pa.array(total)], ["word", "n"])

    partial = docs.select("text").mapInArrow(count, "word int, n long")
    out = np.zeros(len(words), np.int64)
    for row in partial.groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[row["word"]] = row["n"]
    return out


def _place(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Index of each hash among the sorted ``known``, -1 if it isn't there."""
    if not len(known):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, -1)


class Templates:
    """Templates as sets of word numbers in order of frequency, with the index of their prefixes."""

    def __init__(self, templates: list[tuple[str, str]], words: np.ndarray, counts: np.ndarray, share: float):
        self.words = words
        rank = np.empty(len(words), np.int64)
        rank[np.lexsort([words, counts])] = np.arange(len(words))
        self.labels, self.ordered, self.needed, self.length = [], [], [], []
        self.own = []  # by template, which of the known words are its own
        for label, text in templates:
            hashes = hashes_of(text)
            own = np.unique(_place(words, hashes))
            if not len(own):
                continue
            self.length.append(ceil(len(hashes) / share - 1e-9))
            self.own.append(np.isin(np.arange(len(words)), own))
            self.labels.append(label)
            self.ordered.append(own[np.argsort(rank[own])].tolist())
            self.needed.append(ceil(share * len(own) - 1e-9))
        self.index: dict[int, list[tuple[int, int]]] = {}
        for t, own in enumerate(self.ordered):
            for place in range(len(own) - self.needed[t] + 1):
                self.index.setdefault(own[place], []).append((t, place))
        self.is_prefix = np.zeros(len(words), bool)
        self.is_prefix[list(self.index)] = True

    def meets(self, held: set[int], size: int) -> Iterator[tuple[str, float]]:
        """Templates that a block meets: ``held`` of the known words, ``size`` different words in all."""
        first: dict[int, int] = {}
        for word in held:
            for t, place in self.index.get(word, ()):
                first[t] = min(place, first.get(t, place))
        for t, place in sorted(first.items()):
            own, needed = self.ordered[t], self.needed[t]
            if size < needed or len(own) - place < needed:
                continue
            shared = sum(w in held for w in own[place:])
            if shared >= needed:
                yield self.labels[t], shared / len(own)

    def passages(self, at: np.ndarray, line: np.ndarray) -> Iterator[tuple[int, str, float]]:
        """First word, label and containment of passages of one text that meet a template across lines.

        ``at`` has the known word at each place of the text or -1, ``line`` its line.
        """
        near: dict[int, list[int]] = {}
        for place in np.flatnonzero((at >= 0) & self.is_prefix[at]).tolist():
            for t, _ in self.index[int(at[place])]:
                near.setdefault(t, []).append(place)
        for t, places in sorted(near.items()):
            width, begin = self.length[t], 0
            for k, place in enumerate(places):
                if k + 1 == len(places) or places[k + 1] - place >= 2 * width - 1:
                    low, high = max(0, places[begin] - width + 1), place + width
                    begin = k + 1
                    if line[low] != line[min(high, len(line)) - 1]:
                        yield from self._windows(t, at[low:high], line[low:high], low)

    def _windows(self, t: int, at: np.ndarray, line: np.ndarray, low: int) -> Iterator[tuple[int, str, float]]:
        """Best window of each run of overlapping windows that meet template ``t``."""
        needed, width, total = self.needed[t], self.length[t], len(self.ordered[t])
        places = np.flatnonzero((at >= 0) & self.own[t][at])
        if len(np.unique(at[places])) < needed:
            return
        words, places = at[places].tolist(), places.tolist()
        held: dict[int, int] = {}
        first, best, reach, alone = 0, None, -1, False
        for k, (word, place) in enumerate(zip(words, places)):
            held[word] = held.get(word, 0) + 1
            while place - places[first] >= width:
                held[words[first]] -= 1
                if not held[words[first]]:
                    del held[words[first]]
                first += 1
            if len(held) < needed:
                continue
            if best is not None and places[first] > reach:
                if not alone:
                    yield low + best[1], self.labels[t], best[0] / total
                best, alone = None, False
            reach = place
            if best is None or len(held) > best[0]:
                best = (len(held), places[first])
            same = {w for w, p in zip(words[first : k + 1], places[first : k + 1]) if line[p] == line[place]}
            alone = alone or len(same) >= needed
        if best is not None and not alone:
            yield low + best[1], self.labels[t], best[0] / total


def _phrase_places(hashes: np.ndarray, rows: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """Indexes of the words where a phrase begins, by phrase."""
    for phrase, label in PHRASES.items():
        wanted = hashes_of(phrase)
        n = len(hashes) - len(wanted) + 1
        if n <= 0:
            continue
        match = rows[:n] == rows[len(wanted) - 1 :]
        for k, word in enumerate(wanted):
            match &= hashes[k : k + n] == word
        yield label, np.flatnonzero(match)


def scan_slice(part: vec.Slice, batches: list[Templates], wrapped: bool = False) -> list[tuple]:
    """n_words, n_base, first_word, last_word, base labels, blocks met, for each text."""
    words, hashes = _words(part)
    begin = np.searchsorted(words.rows, np.arange(part.rows + 1))
    places: list[list[int]] = [[] for _ in range(part.rows)]
    base: list[set[str]] = [set() for _ in range(part.rows)]
    for label, found in _phrase_places(hashes, words.rows):
        for at in found.tolist():
            row = int(words.rows[at])
            places[row].append(at - int(begin[row]))
            base[row].add(label)

    blocks: list[list[tuple]] = [[] for _ in range(part.rows)]
    if len(words):
        breaks = np.zeros(len(part.data) + 1, np.int64)
        np.cumsum(part.data == 0x0A, out=breaks[1:])
        # Lines are numbered over the slice; a new text begins a new line.
        line = breaks[words.starts] + words.rows
        ends = np.flatnonzero(np.concatenate([line[1:] != line[:-1], [True]])) + 1
        starts = np.concatenate([[0], ends[:-1]])
        for templates in batches:
            at = _place(templates.words, hashes)
            hit = np.flatnonzero((at >= 0) & templates.is_prefix[at]) if len(templates.words) else []
            for one in np.unique(np.searchsorted(ends, hit, "right")).tolist():
                a, b = int(starts[one]), int(ends[one])
                held = {w for w in at[a:b].tolist() if w >= 0}
                row = int(words.rows[a])
                number = int(line[a] - row - breaks[part.offsets[row]])
                size = len(np.unique(hashes[a:b]))
                blocks[row] += [(number, label, share) for label, share in templates.meets(held, size)]
            for row in np.unique(words.rows[hit]).tolist() if wrapped else ():
                a, b = int(begin[row]), int(begin[row + 1])
                for place, label, share in templates.passages(at[a:b], line[a:b]):
                    blocks[row].append((int(line[a + place] - row - breaks[part.offsets[row]]), label, share))
    out = []
    for row in range(part.rows):
        own = places[row]
        edge = (min(own), max(own)) if own else (None, None)
        out.append((int(begin[row + 1] - begin[row]), len(own), *edge, base[row], blocks[row]))
    return out


def scan(
    docs: DataFrame,
    templates: list[tuple[str, str]] | None = None,
    share: float = CONTAINMENT,
    wrapped: bool = False,
) -> DataFrame:
    """License evidence in every document (doc_id, text): phrases, and blocks that meet a template.

    Blocks are lines, with ``wrapped`` also passages across lines.
    ``score`` is 1 with a phrase, else the largest containment met, else 0.
    """
    templates = TEMPLATES if templates is None else templates
    batches, size = [[]], 0
    for one in templates:
        if batches[-1] and size + len(one[1]) > BATCH_WORDS:
            batches.append([])
            size = 0
        batches[-1].append(one)
        size += len(one[1])
    ready = []
    for batch in batches:
        words = vocabulary(batch)
        ready.append(Templates(batch, words, frequencies(docs, words), share))
    sent = docs.sparkSession.sparkContext.broadcast(ready)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.list_(pa.struct({"line": pa.int32(), "label": pa.string(), "containment": pa.float64()}))
        kinds = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.float64(), block]
        names = [f.strip().split()[0] for f in SCANNED.split(", ")]
        for batch in rows:
            ids = batch.column("doc_id").to_pylist()
            for part in vec.slices(batch.column("text")):
                made = []
                for row, (n, n_base, first, last, base, met) in enumerate(scan_slice(part, sent.value, wrapped)):
                    labels = ",".join(sorted(base | {label for _, label, _ in met}))
                    score = 1.0 if base else max([s for _, _, s in met], default=0.0)
                    found = [{"line": a, "label": b, "containment": c} for a, b, c in met]
                    made.append((ids[part.first + row], n, n_base, first, last, ",".join(sorted(base)), labels, score, found))
                columns = [pa.array([r[k] for r in made], kind) for k, kind in enumerate(kinds)]
                yield pa.record_batch(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCANNED)
