"""Quality rules: text shape, and perplexity bands under a code-point n-gram model.

The model (``point_model``) is counted over the words of all documents. A text's
log-perplexity is the mean negative log-probability of its characters and word
ends: tasks add up those of frequent n-grams, a join by hash the others. Per
language, a band of ``width`` scaled median deviations around the median
is fixed over all texts that pass the base rules; a text outside its band is
rejected, below it as too repetitive and above it as too unlike the language.

Defined cases: null texts have no words; texts without words have no perplexity
and fail the base rules; a null language counts as "und"; repeated rows
are judged each; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lotwise.llm import point_model, vec
from lotwise.llm.common import discard, written
from lotwise.llm.point_model import FREQUENT, Frequent

MIN_WORDS = 50
REPEAT_WINDOW = 3
# Scaled median deviations. Chosen on the labelled rows of sf0.1 outside the held-out
# fold: down to 4.5 a narrower band rejects more junk than clean texts, below it the reverse.
WIDTH = 4.5
LEAST_WIDTH = 0.02  # nats; keeps a band open where most texts are alike, below the width of ordinary corpora
STEPS = 1000  # histogram bins per nat

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCORES = f"lang string, {', '.join(f'{c} long' for c in COUNTS)}, cost long, rare array<long>, times array<long>"


def repeated(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items given in order: whether its hash occurs twice in its row, and whether it occurred before."""
    key = vec.mix(hashes + vec.mix(rows.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return twice, later


def rare_grams(
    rows: np.ndarray, kind: np.ndarray, word: np.ndarray, hashes: np.ndarray, n: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-grams left to the join, text by text: offsets of the ``n`` texts, hashes and occurrences.

    ``rows`` and ``kind`` are given for every word, ``hashes`` for n-grams of the kinds ``word``, in order.
    """
    held = np.bincount(word, minlength=int(kind.max()) + 1)
    first = np.cumsum(held) - held
    concerned = held[kind] > 0
    pairs, times = np.unique(rows[concerned] * len(held) + kind[concerned], return_counts=True)
    row, kind = pairs // len(held), pairs % len(held)
    size = held[kind]
    at = np.arange(size.sum()) + np.repeat(first[kind] - (np.cumsum(size) - size), size)
    offsets = np.zeros(n + 1, np.int32)
    offsets[1:] = np.cumsum(np.bincount(row, weights=size, minlength=n))
    return offsets, hashes[at], np.repeat(times, size)


def measure(part: vec.Slice, model: Frequent) -> tuple[dict[str, np.ndarray], tuple]:
    """Counts and cost of frequent n-grams of each text of a slice; its other n-grams (``rare_grams``)."""
    n = part.rows
    zero = np.zeros(n, np.int64)
    out = dict.fromkeys([*COUNTS, "cost"], zero)
    none = np.zeros(n + 1, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(part.data):
        return out, none
    symbol = np.zeros(len(part.data) + 1, np.int64)
    np.cumsum(_SYMBOL[part.data], out=symbol[1:])
    out["n_symbols"] = symbol[part.offsets[1:]] - symbol[part.offsets[:-1]]
    prefix = vec.byte_hash(part.data)
    words = vec.spans(part)
    if not len(words):
        return out, none
    hashes = vec.span_hash(prefix, words.starts, words.ends)
    points, before = vec.code_points(part)
    chars = before[words.ends] - before[words.starts]
    out["n_words"] = np.bincount(words.rows, minlength=n)
    out["word_chars"] = np.bincount(words.rows, weights=chars, minlength=n).astype(np.int64)

    lines = vec.spans(part, vec.NEWLINE)
    word_starts = np.zeros(len(part.data) + 1, np.int64)
    word_starts[words.starts + 1] = 1
    np.cumsum(word_starts, out=word_starts)
    with_word = word_starts[lines.ends] > word_starts[lines.starts]
    line_rows = lines.rows[with_word]
    _, later = repeated(line_rows, vec.span_hash(prefix, lines.starts[with_word], lines.ends[with_word]))
    out["n_dup_lines"] = np.bincount(line_rows[later], minlength=n)

    windows, first = vec.window_hashes(hashes, words.rows, REPEAT_WINDOW)
    twice, _ = repeated(words.rows[first], windows)
    covered = np.zeros(len(words), bool)
    for k in range(REPEAT_WINDOW):
        covered[first[twice] + k] = True
    out["n_repeat_words"] = np.bincount(words.rows[covered], minlength=n)

    _, chosen, kind = np.unique(hashes, return_index=True, return_inverse=True)
    columns, word = point_model.grams(point_model.normalised(points), before[words.starts[chosen]], chars[chosen])
    wanted = point_model.keys(columns)
    costs, hit = model.find(wanted)
    cost_of_kind = np.bincount(word, weights=costs, minlength=len(chosen))
    out["cost"] = np.bincount(words.rows, weights=cost_of_kind[kind], minlength=n)
    return out, rare_grams(words.rows, kind, word[~hit], wanted[~hit], n)


def scores(docs: DataFrame, model: Frequent) -> DataFrame:
    """Every row as ``doc``, with its language, its counts, the cost of its frequent n-grams, and its other n-grams."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([StructField("doc", docs.schema), *StructType.fromDDL(SCORES).fields])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vec.slices(batch.column("text")):
                got, (offsets, rare, times) = measure(part, sent.value)
                rows = batch.slice(part.first, part.rows)
                lang = rows.column("lang").fill_null("und")
                columns = {"doc": pa.StructArray.from_arrays(rows.columns, fields=list(rows.schema)), "lang": lang}
                columns |= {k: pa.array(v.astype(np.int64)) for k, v in got.items()}
                columns["rare"] = pa.ListArray.from_arrays(offsets, rare)
                columns["times"] = pa.ListArray.from_arrays(offsets, times.astype(np.int64))
                yield pa.record_batch(columns)

    return docs.mapInArrow(score, schema)


def perplexities(scored: DataFrame, model: DataFrame) -> DataFrame:
    """Rows of ``scores`` with ``log_perplexity`` (null without words), by joining rare n-grams with the model.

    ``scored`` must be written and have ``row``, a key of its rows.
    """
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("g"))
    rare = rare.select("row", F.col("g.rare").alias("key"), F.col("g.times").alias("times"))
    rest = rare.join(model, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("cost")).alias("_rest"))
    total = F.col("cost") + F.coalesce("_rest", F.lit(0))
    events = F.col("word_chars") + F.col("n_words")
    value = F.when(events > 0, total / (events * point_model.UNIT))
    return scored.drop("rare", "times").join(rest, "row", "left").withColumn("log_perplexity", value).drop("_rest")


def base_failed(min_words: int = MIN_WORDS) -> F.Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _middle(counts: DataFrame, value: str) -> DataFrame:
    """Lower median per language of a histogram (lang, value, n); one row per bin, so small."""
    running = Window.partitionBy("lang").orderBy(value)
    whole = Window.partitionBy("lang")
    counts = counts.withColumn("_upto", F.sum("n").over(running)).withColumn("_all", F.sum("n").over(whole))
    return counts.filter(2 * F.col("_upto") >= F.col("_all")).groupBy("lang").agg(F.min(value).alias("middle"))


def bands(scored: DataFrame, width: float = WIDTH) -> DataFrame:
    """Per language the lower and upper log-perplexity, from all texts that pass the base rules."""
    bins = (
        scored.filter(~base_failed())
        .groupBy("lang", F.round(F.col("log_perplexity") * STEPS).cast("long").alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    bins = written(bins, "perplexity-bins")
    middle = written(_middle(bins, "bin"), "perplexity-middle")
    away = (
        bins.join(middle, "lang")
        .groupBy("lang", F.abs(F.col("bin") - F.col("middle")).alias("away"))
        .agg(F.sum("n").alias("n"))
    )
    spread = _middle(away, "away").withColumnRenamed("middle", "spread")
    half = F.greatest(F.lit(width * 1.4826) * F.col("spread") / STEPS, F.lit(LEAST_WIDTH))
    centre = F.col("middle") / STEPS
    found = middle.join(spread, "lang").select("lang", (centre - half).alias("lower"), (centre + half).alias("upper"))
    return written(found, "perplexity-bands")


def _scored(docs: DataFrame, frequent: int) -> tuple[DataFrame, DataFrame]:
    """``scores`` of all rows under the model of these rows, written with a key ``row``; the model."""
    model = point_model.estimate(point_model.counts(docs.select("text")))
    scored = scores(docs, point_model.frequent(model, frequent)).withColumn("row", F.monotonically_increasing_id())
    return scored, model


def _verdicts(values: DataFrame, width: float) -> DataFrame:
    inside = F.col("log_perplexity").between(F.col("lower"), F.col("upper"))
    return (
        values.join(bands(values, width), "lang", "left")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
    )


def judge(docs: DataFrame, width: float = WIDTH, frequent: int = FREQUENT) -> DataFrame:
    """Verdict on every document: its counts, ``base_failed``, ``kept``, log-perplexity and band.

    ``docs`` needs doc_id, text and lang. ``frequent`` bounds the n-grams sent to
    tasks and does not change results.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    scored, model = _scored(docs, frequent)
    scored = written(scored.withColumn("doc", F.struct(F.col("doc.doc_id").alias("doc_id"))), "quality-scores")
    values = written(perplexities(scored, model), "quality-values")
    discard(scored, model)
    return _verdicts(values, width).withColumn("doc_id", F.col("doc.doc_id")).drop("doc", "row", "cost")


def keep(docs: DataFrame, width: float = WIDTH, frequent: int = FREQUENT) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    scored, model = _scored(docs, frequent)
    scored = written(scored, "quality-scores")
    values = written(perplexities(scored.drop("doc"), model), "quality-values")
    discard(model)
    kept = _verdicts(values, width).filter("kept").select("row")
    return scored.join(kept, "row", "left_semi").select("doc.*")
