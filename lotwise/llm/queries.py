"""The text operators as queries over the test tables, with SQL twins where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import (
    cross_tokens,
    decontaminate,
    licenses,
    near_dedup,
    near_dups,
    ordinal,
    pieces,
    preferences,
    quality,
    resample,
    toxicity,
    url_filter,
    warc,
)
from lotwise.llm.common import table

PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_50k.json"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    first = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    return judged.select(*first, "log_perplexity", "lower", "upper")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = toxicity.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "held_out", "score", "predicted", "n_restored", "n_evidence")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.join(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), wrapped=True).drop("blocks")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds the URLs of pages in which at least one character in 50 is an asterisk, a mark of junk."""
    pages = table(spark, sf_dir, "pages")
    marks = F.length("html") - F.length(F.translate("html", "*", ""))
    return url_filter.judge(pages, pages.filter(50 * marks > F.length("html")).select("url"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades 0 (poor), 1 (good but toxic) and 2 (good)."""
    labels = table(spark, sf_dir, "labels")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    return ordinal.grade(table(spark, sf_dir, "documents"), labels.select("doc_id", grade.alias("grade")), 3)


def op10_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.format_pairs(*preferences.replaced_reply(table(spark, sf_dir, "conversations")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path(BYTES), public_tokenizers.path(PIECES)
    return cross_tokens.align(table(spark, sf_dir, "documents"), *paths)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_toxicity": op3_toxicity,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_decontamination": op5_decontamination,
    "op6_license_scan": op6_license_scan,
    "op7_url_filter": op7_url_filter,
    "op8_warc": op8_warc,
    "op9_quality_grades": op9_quality_grades,
    "op10_preference_pairs": op10_preference_pairs,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_near_dedup": op12_near_dedup,
    "op13_cross_tokenizer": op13_cross_tokenizer,
}

_URL_SQL = """
WITH cut AS (
  SELECT page_id, html,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest
  FROM pages
), parts AS (
  SELECT page_id, html,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut
), named AS (
  SELECT *, regexp_replace(regexp_replace(host, ':[0-9]*\\z', ''), '^(www|m)\\.', '') AS short,
         regexp_replace(path, '(\\.html|/)\\z', '') AS tail
  FROM parts
), listed AS (
  SELECT DISTINCT short || tail AS url FROM named
  WHERE short <> '' AND 50 * (length(html) - length(replace(html, '*', ''))) > length(html)
), rules(verdict, host, path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fitting AS (
  SELECT n.page_id, n.host, n.path, n.short, n.tail, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY n.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS place
  FROM named n LEFT JOIN rules r
    ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path)
)
SELECT f.page_id, f.host, f.path, f.rule,
       coalesce(f.verdict, CASE WHEN l.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       l.url IS NOT NULL AS is_listed
FROM fitting f LEFT JOIN listed l ON f.short <> '' AND l.url = f.short || f.tail
WHERE f.place = 1
"""

_WARC_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p
), b AS (
  SELECT *, array_to_string(list_transform(range(8), lambda k: array_to_string(list_transform(range(4),
           lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             1 + ((('0x' || substr(hex, CAST(5 * k + 1 AS BIGINT), 5))::INTEGER >> CAST(15 - 5 * j AS INTEGER)) & 31), 1)), '')), '')
         AS payload_digest,
         min(page_id) OVER (PARTITION BY hex) AS first
  FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""

_PREFERENCE_SQL = """
WITH last AS (
  SELECT conv_id AS pair_id, max(turn) AS last, arg_max(text, turn) AS reply
  FROM conversations WHERE role = 'assistant' GROUP BY conv_id
), known AS (
  SELECT pair_id, last, reply,
         coalesce(lead(reply) OVER (ORDER BY pair_id), first_value(reply) OVER (ORDER BY pair_id)) AS other
  FROM last
), chosen AS (
  SELECT k.pair_id, c.turn, c.role, c.text, k.last, k.other, c.turn < k.last OR k.reply = k.other AS common
  FROM conversations c JOIN known k ON c.conv_id = k.pair_id
), rows AS (
  SELECT pair_id, CASE WHEN common THEN 'prompt' ELSE 'chosen' END AS part, turn, role, text FROM chosen
  UNION ALL
  SELECT pair_id, 'rejected', turn, role, CASE WHEN turn = last THEN other ELSE text END FROM chosen WHERE NOT common
)
SELECT pair_id, part, turn, role,
       '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered,
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length('<|im_start|>' || role) + 1 END AS trained_from,
       CASE WHEN part <> 'prompt' AND role = 'assistant'
            THEN length('<|im_start|>' || role || text || '<|im_end|>') + 2 END AS trained_to
FROM rows
"""

# CRC-32 of UTF-8 bytes: the table of byte remainders by its rule, then one step a byte.
_RESAMPLE_SQL = """
WITH RECURSIVE step(k, r) AS (
  SELECT 0, list_transform(range(256), lambda x: x::BIGINT)
  UNION ALL
  SELECT k + 1, list_transform(r, lambda x: xor(x >> 1, (x & 1) * 3988292384)) FROM step WHERE k < 8
), crc AS MATERIALIZED (
  SELECT r FROM step WHERE k = 8
), texts AS (
  SELECT 0 AS side, row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL
  SELECT 1, row_number() OVER (), NULL, coalesce(text, '') FROM benchmark
), split AS (
  SELECT side, n, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM texts
), found AS (
  SELECT side, n, unnest(words) AS feature FROM split
  UNION ALL
  SELECT side, n, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) FROM split
), kinds AS (
  SELECT DISTINCT feature, hex(encode(feature)) AS code FROM found
), coded AS (
  SELECT feature, list_transform(range(len(code) // 2),
           lambda i: ('0x' || substr(code, CAST(2 * i + 1 AS BIGINT), 2))::BIGINT) AS codes FROM kinds
), hashed AS (
  SELECT feature, xor(list_reduce(list_prepend(4294967295::BIGINT, codes),
           lambda c, b: xor(c >> 8, r[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM coded, crc
), counted AS (
  SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t
  FROM found JOIN hashed USING (feature) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
                                 / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
  FROM counted
), weights AS (
  SELECT n, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight
  FROM found JOIN hashed USING (feature) JOIN gains USING (bucket) WHERE side = 0 GROUP BY n
), scored AS (
  SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         len(words) >= 20 AS able,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
                                                      + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM split LEFT JOIN weights USING (n) WHERE side = 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST) AS place,
         count(*) FILTER (able) OVER () AS n_able
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 25 * n_able // 100 THEN place END AS rank
FROM placed
"""

_DEDUP_SQL = """
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words
  FROM documents
), shingled AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingle
  FROM split WHERE len(words) > 0
), sized AS (
  SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
  FROM shingled a JOIN shingled b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared s JOIN sized a ON a.doc_id = x JOIN sized b ON b.doc_id = y
  WHERE 100 * s.n >= 80 * (a.n + b.n - s.n)
), reach(doc_id, other) AS (
  SELECT x, y FROM links
  UNION
  SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other
), least AS (
  SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, l.other) AS component_id,
       d.doc_id = least(d.doc_id, l.other) AS kept
FROM documents d LEFT JOIN sized s USING (doc_id) LEFT JOIN least l USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {
    "op7_url_filter": _URL_SQL,
    "op8_warc": _WARC_SQL,
    "op10_preference_pairs": _PREFERENCE_SQL,
    "op11_importance_resampling": _RESAMPLE_SQL,
    "op12_near_dedup": _DEDUP_SQL,
}
