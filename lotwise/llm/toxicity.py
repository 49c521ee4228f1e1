"""Toxicity: restore disguised words by a noisy channel, then score the restored text.

Every word is reduced to its core; words that look disguised, and runs of single
letters set apart by spaces, are decoded by ``lattice`` under a character model
counted over all documents. So are words with look-alikes at their ends or doubled
letters, which keep the evidence of their core as well, and adjacent fragments that
joined make evidence: other fragments could not change a score. When texts are scored,
a lattice is first walked together with the trie of evidence, and only words of which
some reading reaches evidence are decoded: no other can change a score. Evidence is learnt from labelled rows: words and word
beginnings that are found in toxic texts so much more often than chance allows
that testing all of them would hardly ever admit a wrong one. Each occurrence of a
word counts with the log-odds of its best evidence; a logistic regression on their
sum, the strongest of them and the length of the text gives the score.

Labels are taken from at most about ``LABELLED`` rows outside the held-out fold
(chosen by a hash of doc_id), one row per group of near copies.

Defined cases: a null or empty text has no evidence and the score of such texts; a
repeated row is scored each; labels that are null are not used, and of several
labels for a doc_id the toxic one holds; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import char_model, vec
from lotwise.llm.common import fold_of, written
from lotwise.llm.lattice import Restorer, core, is_disguised, is_doubtful, readings, with_end_marks

LABELLED = 20_000
THRESHOLD = 0.7
PREFIXES = (4, 5, 6)
FALSE_RATE = 0.01  # chance that any piece of evidence is admitted wrongly
LEAST = 0.4  # share of toxic texts among those with the evidence, at its lower bound
SHINGLE = 5
_WORDS = re.compile(r"[^\W\d_]+")
_MARKS = ".,;:?\"'"  # at the ends of words, that ``core`` takes off and that stand for no letter
KNOWN_WORDS = 300_000

SCORED = "doc_id long, score double, n_restored long, n_evidence long"


def evidence_of(text: str) -> list[str]:
    """Words of a restored text and their beginnings."""
    out = []
    for word in _WORDS.findall(text):
        out.append(word)
        out += ["^" + word[:n] for n in PREFIXES if len(word) > n]
    return out


@dataclass
class Found:
    """What a slice holds, by text."""

    words: np.ndarray
    restored: np.ndarray
    evidence: np.ndarray  # occurrences of words with evidence
    total: np.ndarray  # sum of their log-odds
    most: np.ndarray  # the largest of them


class Reader:
    """Reads texts in one task; keeps what it knows of words, up to a number of them."""

    def __init__(self, restorer: Restorer, odds: dict[str, float] | None = None):
        self.restorer, self.odds = restorer, odds
        self.known: dict[str, tuple] = {}
        # Evidence by kind, and what it begins with, for fragments.
        self.whole = {piece for piece in odds or () if not piece.startswith("^")}
        self.heads = {piece[1:] for piece in odds or () if piece.startswith("^")}
        self.starts = {word[:n] for piece in odds or () for word in [piece.lstrip("^")] for n in range(1, len(word))}
        self.two = {piece.lstrip("^")[:2] for piece in odds or ()}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.late: dict[str, str] = {}  # words that are read for their neighbours only

    def _of(self, text: str, inner: str | None = None) -> tuple[bool, tuple[str, ...], float, str | None, str]:
        """Whether a word or run was restored, its evidence, the best log-odds, what it reads as (None: not read yet), and ``text``.

        ``text`` has look-alikes at its ends, ``inner`` is its core.
        """
        inner = text if inner is None else inner
        if self.odds is not None and self._begins_otherwise(text):
            return (True, (), 0.0, None, text) if is_disguised(inner) else (False, (), 0.0, inner, text)
        if self.odds is not None and not self._may_count(text, inner):
            # No reading is evidence or the beginning of any, so which one is best can't change a score.
            if is_disguised(inner):
                return True, (), 0.0, None, text
            return False, (), self._best(evidence_of(inner)), inner, text
        if restored := is_disguised(inner):
            inner = self.restorer.restore(text)
            found = evidence_of(inner)
        else:
            found = evidence_of(inner)
            if is_doubtful(text):
                other = self.restorer.restore(text)
                restored = other != inner
                found += evidence_of(other) if restored else []
        if self.odds is None:
            return restored, tuple(found), 0.0, inner, text
        return restored, (), self._best(found), inner, text

    def _begins_otherwise(self, text: str) -> bool:
        """Whether a word of letters begins like no evidence, which no reading of doubled letters can change."""
        return text[:2] not in self.two and text[:1] != text[1:2] and text.isalpha()

    def _may_count(self, text: str, inner: str) -> bool:
        """Whether a reading of the lattice holds evidence, or is the beginning of some.

        Walks the lattice and the trie of evidence together: a state is the word read
        so far, or None once no evidence begins like it.
        """
        if not (is_disguised(inner) or is_doubtful(text)):
            return True
        states: set[str | None] = {""}
        for options in readings(text):
            after: set[str | None] = set()
            for state in states:
                for letters, _ in options:
                    if not letters:
                        after.add(state)
                    elif not _WORDS.fullmatch(letters):  # ends a word
                        if state in self.whole:
                            return True
                        after.add("")
                    elif state is None:
                        after.add(None)
                    else:
                        longer = state + letters
                        if any(longer[:n] in self.heads for n in PREFIXES):
                            return True
                        after.add(longer if longer in self.starts or longer in self.whole else None)
            states = after
        return any(states)

    def _reading(self, entry: tuple) -> str:
        """What a word reads as; words that cannot be evidence are decoded only beside fragments."""
        if entry[3] is not None:
            return entry[3]
        text = entry[4]
        if text not in self.late:
            if len(self.late) > KNOWN_WORDS:
                self.late.clear()
            self.late[text] = self.restorer.restore(text)
        return self.late[text]

    def _best(self, found: list[str]) -> float:
        return max([self.odds.get(f, 0.0) for f in found], default=0.0)

    def _kinds(self, part: vec.Slice):
        """Words of a slice, the kind of each, and what is known of the kinds."""
        words, hashes = vec.word_hashes(part)
        if not len(words):
            return words, np.zeros(0, np.int64), []
        _, first, kind = np.unique(hashes, return_index=True, return_inverse=True)
        blob, got = part.data.tobytes(), []
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist()):
            word = blob[a:b]
            entry = self.known.get(word)
            if entry is None:
                shown = word.decode("utf-8", "replace")
                plain = shown.lower().strip(_MARKS)
                both = (plain, plain) if plain.isalpha() else (with_end_marks(shown), core(shown))
                entry = self.known[word] = self._of(*both)
            got.append(entry)
        return words, kind, got

    def pieces(self, part: vec.Slice) -> list[set[str]]:
        """All evidence in each text, for learning."""
        sets = [set() for _ in range(part.rows)]
        words, kind, got = self._kinds(part)
        for row, k in zip(words.rows.tolist(), kind.tolist()):
            sets[row].update(got[k][1])
        for row, run in self._spaced(part, words):
            sets[row].update(self._of(run)[1])
        return sets

    def read(self, part: vec.Slice) -> Found:
        words, kind, got = self._kinds(part)
        restored = np.array([g[0] for g in got], np.float64)[kind]
        odds = np.array([g[2] for g in got], np.float64)[kind]
        rows = words.rows
        spaced = [(row, self._of(run)[2]) for row, run in self._spaced(part, words)]
        spaced += self._fragments(rows, kind, got, odds)
        if spaced:
            rows = np.concatenate([rows, [s[0] for s in spaced]])
            restored = np.concatenate([restored, np.ones(len(spaced))])
            odds = np.concatenate([odds, [s[1] for s in spaced]])
        most = np.zeros(part.rows)
        np.maximum.at(most, rows[odds > 0], odds[odds > 0])

        def by_text(values: np.ndarray) -> np.ndarray:
            return np.bincount(rows, weights=values, minlength=part.rows)

        counts = [by_text(v).astype(np.int64) for v in (np.ones(len(rows)), restored, odds > 0)]
        return Found(*counts, by_text(odds), most)

    def _joins(self, one: str, two: str) -> bool:
        """Whether two fragments begin or make evidence."""
        known = self.pairs.get((one, two))
        if known is None:
            if len(self.pairs) > KNOWN_WORDS:
                self.pairs.clear()
            known = one + two in self.starts or self._best(evidence_of(one + two)) > 0
            self.pairs[one, two] = known
        return known

    def _fragments(self, rows: np.ndarray, kind: np.ndarray, got: list, odds: np.ndarray) -> list[tuple[int, float]]:
        """Text and log-odds of runs of fragments, none of them evidence, that are evidence when restored."""
        out: list[tuple[int, float]] = []
        begins = np.array([g[3] in self.starts for g in got], bool)[kind] & (odds <= 0)
        at = np.flatnonzero(begins[:-1] & (odds[1:] <= 0) & (rows[1:] == rows[:-1]))
        if not len(at):
            return out
        pairs, which = np.unique(kind[at] * len(got) + kind[at + 1], return_inverse=True)
        joins = [self._joins(got[a][3], self._reading(got[b])) for a, b in zip(*(x.tolist() for x in divmod(pairs, len(got))))]
        free = 0
        for begin in at[np.array(joins, bool)[which]].tolist():
            if begin < free:
                continue
            joined, last = got[kind[begin]][3], None
            for place in range(begin + 1, len(rows)):
                if rows[place] != rows[begin] or odds[place] > 0 or joined not in self.starts:
                    break
                joined += self._reading(got[kind[place]])
                if self._best(evidence_of(joined)) > 0:
                    last = place
            if last is None:
                continue
            fragments = [f for k in kind[begin : last + 1].tolist() if (f := self._reading(got[k]))]
            # Runs of three or more single characters are read by ``_spaced``.
            if len(fragments) > 1 and (len(fragments) < 3 or max(map(len, fragments)) > 1):
                best = self._best(evidence_of(self.restorer.restore(" ".join(fragments))))
                if best > 0:
                    out.append((int(rows[begin]), best))
                    free = last + 1
        return out

    @staticmethod
    def _spaced(part: vec.Slice, words: vec.Spans) -> Iterator[tuple[int, str]]:
        """Runs of three or more single characters, with the spaces between them."""
        if not len(words):
            return
        blob, (_, before) = part.data.tobytes(), vec.code_points(part)
        single = (before[words.ends] - before[words.starts]) == 1
        edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
        for begin, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
            rows = words.rows[begin:end]
            cuts = [begin, *(begin + 1 + np.flatnonzero(np.diff(rows))).tolist(), end]
            for a, b in zip(cuts, cuts[1:]):
                if b - a >= 3:
                    run = blob[words.starts[a] : words.ends[b - 1]].decode("utf-8", "replace").lower()
                    yield int(words.rows[a]), " ".join(run.split())


def _sketch(part: vec.Slice) -> np.ndarray:
    """Smallest hash of the word windows of each text; near copies mostly share it."""
    words, hashes = vec.word_hashes(part)
    out = np.zeros(part.rows, np.uint64)
    for size in (1, SHINGLE):
        windows, first = vec.window_hashes(hashes, words.rows, size)
        if len(windows):
            rows, start = np.unique(words.rows[first], return_index=True)
            out[rows] = np.minimum.reduceat(windows, start)
    return out.view(np.int64)


def labelled_rows(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """About ``bound`` labelled texts outside the held-out fold, one per group of near copies: text, toxic."""
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold_of(F.col("doc_id")) != 1))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    usable = written(usable, "labels")
    share = min(1.0, bound / max(usable.count(), 1))
    # At most about ``bound`` rows of two numbers, so this side may go to every task.
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(share * 1_000_003) + (share == 1.0))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vec.slices(batch.column("text")):
                some = batch.slice(part.first, part.rows)
                yield some.append_column("sketch", pa.array(_sketch(part)))

    rows = rows.mapInArrow(sketched, "text string, toxic int, sketch long")
    one = rows.groupBy("sketch").agg(F.max(F.struct("toxic", "text")).alias("row"))
    return written(one.select("row.text", "row.toxic"), "toxicity-sample")


def learn(sample: DataFrame, model: char_model.CharModel) -> tuple[dict[str, float], float]:
    """Evidence with its log-odds above the prior's, and the prior share of toxic texts."""
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, tally = Reader(Restorer(sent.value)), {}
        for batch in batches:
            toxic = batch.column("toxic").to_pylist()
            for part in vec.slices(batch.column("text")):
                for row, found in enumerate(reader.pieces(part)):
                    for piece in found:
                        seen = tally.setdefault(piece, [0, 0])
                        seen[0] += toxic[part.first + row] > 0
                        seen[1] += 1
        columns = [list(tally), [v[0] for v in tally.values()], [v[1] for v in tally.values()]]
        kinds = [pa.string(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["piece", "toxic", "n"])

    total, toxic = sample.agg(F.count("*"), F.sum((F.col("toxic") > 0).cast("int"))).first()
    prior = ((toxic or 0) + 0.5) / (total + 1)
    counted = written(
        sample.mapInArrow(count, "piece string, toxic long, n long")
        .groupBy("piece")
        .agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")),
        "toxicity-evidence",
    )
    tested = max(counted.count(), 1)
    share = F.col("toxic") / F.col("n")
    # Chernoff bound on so many toxic texts among n by chance.
    surprise = F.col("n") * (
        share * F.log(share / prior) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - prior))).otherwise(0.0)
    )
    spread = 1.64 * F.sqrt(share * (1 - share) / F.col("n") + 0.6724 / F.col("n") ** 2)
    lower = (share + 1.3448 / F.col("n") - spread) / (1 + 2.6896 / F.col("n"))
    rows = (
        counted.filter(F.col("toxic") > 0)
        .filter((share > prior) & (surprise > float(np.log(tested / FALSE_RATE))) & (lower > LEAST))
        .select("piece", F.log((F.col("toxic") + 0.5) / (F.col("n") - F.col("toxic") + 0.5)).alias("odds"))
        .collect()
    )
    even = float(np.log(prior / (1 - prior)))
    return {r["piece"]: r["odds"] - even for r in rows}, prior


def traits(found: Found) -> np.ndarray:
    """What the regression sees of a text with evidence."""
    return np.stack(
        [np.ones(len(found.words)), np.log1p(found.total), found.most, np.log1p(found.words), found.most > 6], 1
    )


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton steps."""
    weights = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(weights))
        step = np.linalg.solve(curve, x.T @ (y - p) - ridge * weights)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def regression(sample: DataFrame, model: char_model.CharModel, odds: dict[str, float]) -> tuple[np.ndarray, float]:
    """Weights for texts with evidence, and the share of toxic texts among those without (bounded sample)."""
    sent = sample.sparkSession.sparkContext.broadcast((model, odds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, odds = sent.value
        reader = Reader(Restorer(model), odds)
        for batch in batches:
            for part in vec.slices(batch.column("text")):
                found = reader.read(part)
                toxic = batch.column("toxic").slice(part.first, part.rows)
                columns = [toxic, found.words, found.total, found.most]
                yield pa.record_batch([pa.array(c) for c in columns], ["toxic", "words", "total", "most"])

    got = sample.mapInArrow(run, "toxic int, words long, total double, most double").toArrow()
    # Rows come in any order; sums of floats must not depend on it.
    got = got.sort_by([(name, "ascending") for name in got.column_names])
    toxic, words, total, most = (got.column(k).to_numpy() for k in range(4))
    toxic, some = toxic > 0, most > 0
    rest = (toxic[~some].sum() + 0.5) / ((~some).sum() + 10)
    found = Found(words[some], words[some], words[some], total[some], most[some])
    return fit(traits(found), toxic[some].astype(float)), float(min(rest, 0.5))


def _scorer(docs: DataFrame, labels: DataFrame, bound: int):
    """Function that scores the slices of a text column in a task, learnt from all it may use."""
    model = char_model.train(docs.select("text"), fold_case=True)
    sample = labelled_rows(docs, labels, bound)
    odds, _ = learn(sample, model)
    sent = docs.sparkSession.sparkContext.broadcast((model, odds, *regression(sample, model, odds)))

    def scored(column: pa.Array, reader: list) -> Iterator[tuple[vec.Slice, Found, np.ndarray]]:
        model, odds, weights, rest = sent.value
        if not reader:
            reader.append(Reader(Restorer(model), odds))
        for part in vec.slices(column):
            found = reader[0].read(part)
            value = 1 / (1 + np.exp(-np.clip(traits(found) @ weights, -30, 30)))
            yield part, found, np.where(found.most > 0, value, rest)

    return scored


def score(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """Toxicity of every document: doc_id, score, words restored, words with evidence.

    ``docs`` needs doc_id and text; ``labels`` doc_id and toxic.
    """
    scored = _scorer(docs, labels, bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader: list = []
        for batch in batches:
            for part, found, value in scored(batch.column("text"), reader):
                ids = batch.column("doc_id").slice(part.first, part.rows)
                columns = [ids, pa.array(value), pa.array(found.restored), pa.array(found.evidence)]
                yield pa.record_batch(columns, ["doc_id", "score", "n_restored", "n_evidence"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORED)


def predict(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``score`` with the held-out fold and the decision."""
    scored = score(docs, labels)
    return scored.withColumn("held_out", F.coalesce(fold_of(F.col("doc_id")) == 1, F.lit(False))).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bound: int = LABELLED) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    scored = _scorer(docs, labels, bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader: list = []
        for batch in batches:
            for part, _, value in scored(batch.column("text"), reader):
                yield batch.slice(part.first, part.rows).filter(pa.array(value < threshold))

    return docs.mapInArrow(run, docs.schema)
