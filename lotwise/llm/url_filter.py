"""URL filters: path rules, then a blocked Bloom filter in front of an exact hash join.

All of it is DataFrame and SQL functions. A canonical URL is the host in lower case
without a leading ``www.`` or ``m.``, and the path without a final ``/`` or ``.html``;
scheme, port, query and fragment do not count. The filter is a table of 512-bit
blocks, eight words each: one hash chooses the block, others one bit in every word.
Its size is fixed by ``block_bits`` and never by the list, so it may go to every
task. Only URLs that the filter lets through meet the list in an exact join.

Defined cases: a null URL, or one without ``://``, has empty host and path, no
canonical form, and is allowed unless a rule fits; null list entries and repeated
ones do not matter; repeated pages are judged each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import written

WORDS = 8
BLOCK_BITS = 15  # 32 768 blocks of 64 bytes: 2 MB

# (verdict, host, path); the longest that fits wins.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + F.lit(3), F.length(url))
    host = F.regexp_extract(rest, "(?s)^[^/?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(at > 0, lower).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + F.lit(3), F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Null where there is no host."""
    short = F.regexp_replace(F.regexp_replace(host, ":[0-9]*\\z", ""), "^(www|m)\\.", "")
    tail = F.regexp_replace(path, "(\\.html|/)\\z", "")
    return F.when(short != "", F.concat(short, tail))


def longest_rule(host: Column, path: Column, rules=None) -> tuple[Column, Column]:
    """Rule (host and path) that fits and is longest, and its verdict; null without one."""
    rules = RULES if rules is None else rules
    name = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        below = (host == rule_host) | F.endswith(host, F.lit("." + rule_host))
        fits = below & F.startswith(path, F.lit(rule_path))
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _block(url: Column, bits: int) -> Column:
    return F.xxhash64(url, F.lit(0)).bitwiseAND((1 << bits) - 1)


def _bit(url: Column, word: int) -> Column:
    """One bit of 64 for a word of the block, from a second hash."""
    place = F.shiftrightunsigned(F.xxhash64(url, F.lit(1)), 6 * word).bitwiseAND(63)
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def bloom(urls: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Blocked Bloom filter of the canonical URLs of ``url``: block, words (at most 2 ** bits rows)."""
    url = F.col("url")
    parts = [F.bit_or(_bit(url, k)).alias(f"w{k}") for k in range(WORDS)]
    blocks = urls.filter("url is not null").groupBy(_block(url, bits).alias("block")).agg(*parts)
    return blocks.select("block", F.array(*[f"w{k}" for k in range(WORDS)]).alias("words"))


def _possible(url: Column, words: Column) -> Column:
    passed = words.isNotNull()
    for k in range(WORDS):
        passed = passed & (words[k].bitwiseAND(_bit(url, k)) != 0)
    return passed


def listed(urls: DataFrame, list_: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """``urls`` (with a column ``canonical``) with ``is_listed``: whether it is among ``list_.url``.

    Both sides hold canonical URLs.
    """
    known = written(list_.select("url").filter("url is not null").distinct(), "listed-urls")
    # 2 ** bits rows of 72 bytes at most, whatever the list.
    blocks = F.broadcast(written(bloom(known, bits), "url-bloom"))
    flagged = (
        urls.withColumn("_block", _block(F.col("canonical"), bits))
        .join(blocks, F.col("_block") == F.col("block"), "left")
        .withColumn("_possible", F.coalesce(_possible(F.col("canonical"), F.col("words")), F.lit(False)))
        .drop("_block", "block", "words")
    )
    flagged = written(flagged, "url-flags")
    rest = flagged.filter("NOT _possible").withColumn("is_listed", F.lit(False))
    hits = flagged.filter("_possible").join(
        known.select(F.col("url").alias("canonical"), F.lit(True).alias("is_listed")), "canonical", "left"
    )
    hits = hits.withColumn("is_listed", F.coalesce("is_listed", F.lit(False)))
    return rest.unionByName(hits).drop("_possible")


def judge(pages: DataFrame, list_: DataFrame, rules=None, bits: int = BLOCK_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict, is_listed for every page (page_id, url).

    A rule's verdict holds; where no rule fits, listed URLs are blocked.
    ``list_`` has a column ``url`` of URLs in any form.
    """
    url = F.col("url")
    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"),
                          path_of(url).alias("path"))
    chosen = chosen.select(
        "page_id",
        F.coalesce("host", F.lit("")).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
    ).withColumn("canonical", canonical(F.col("host"), F.col("path")))
    blocked = list_.select(canonical(host_of(url), path_of(url)).alias("url"))
    marked = listed(chosen, blocked, bits)
    name, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("is_listed"), F.lit("block")).otherwise(F.lit("allow"))
    return marked.select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "is_listed"
    )
