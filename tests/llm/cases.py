"""Awkward rows that every operator has to take."""

from pyspark.sql import functions as F

WORDS = "the quick brown fox jumps over a lazy dog while nine small birds sing in tall old trees near our quiet home"


def text_of(n: int, seed: int = 1) -> str:
    """n words, hardly ever repeating a window of three."""
    words = WORDS.split()
    state, out = seed * 7919 + 1, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(words[(state >> 8) % len(words)] + "abcdefghij"[(state >> 16) % 10])
    return " ".join(out)


def awkward(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""
    rows = [
        (1, text_of(80), "en", "a"),
        (1, text_of(80), "en", "a"),  # the same row again
        (2, text_of(80), "en", "b"),  # a copy
        (3, None, "en", "a"),
        (4, "", None, None),
        (5, " \n\t ", "fr", "a"),
        (None, text_of(60, 2), None, "c"),
        (6, text_of(30_000, 3), "en", "c"),
        (7, "x" * 200_000, "en", "c"),
        (8, "Ünïcode – 日本語 \U0001f600 " * 40, "ja", "c"),
        (9, "a\x00b $$$ <tag> & | #1\nline\nline\n", "en", "c"),
        (9, text_of(70, 9), "en", "d"),  # the same id with another text
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    extra = "id key n kind word words block tree node label score lower upper doc n_words base_failed kept sketch"
    for name in extra.split():
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


def empty(spark, schema="doc_id long, text string, lang string, source string"):
    return spark.createDataFrame([], schema)


def by_id(rows, key="doc_id"):
    out = {}
    for row in rows:
        out.setdefault(row[key], []).append(row)
    return out
