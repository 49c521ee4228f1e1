import hashlib
import math
import re
import zlib

import cases
import numpy as np
import pytest

from lotwise.llm import resample, vec
from lotwise.llm.common import ready, table, written

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def buckets_of(text):
    words = words_of(text)
    return [zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def brute(docs, targets):
    """n_features, weight, score and rank of (doc_id, text) rows, in the order of docs."""
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for counts, texts in ((s, [x for _, x in docs]), (t, targets)):
        for text in texts:
            np.add.at(counts, buckets_of(text), 1)
    gain = [
        math.floor(1000 * math.log((b + 1) * (int(s.sum()) + 10_000) / ((a + 1) * (int(t.sum()) + 10_000))))
        for a, b in zip(s.tolist(), t.tolist())
    ]
    out = []
    for doc_id, text in docs:
        own = [gain[b] for b in buckets_of(text)]
        weight = sum(own) // len(own) if own else 0
        name = "" if doc_id is None else doc_id
        h = int(hashlib.sha256(f"7:{name}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = [r for r, (_, text) in zip(out, docs) if len(words_of(text)) >= 20]
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[: 25 * len(able) // 100], 1):
        row[4] = rank
    return sorted(map(tuple, out), key=repr)


def ours(docs, target):
    return sorted(map(tuple, resample.resample(docs, target).collect()), key=repr)


def test_crc_of_spans_and_of_spans_that_go_on():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    starts = rng.integers(0, 2500, 200)
    ends = starts + rng.integers(0, 400, 200)
    one = resample.crc32(data, starts, ends)
    assert one.tolist() == [zlib.crc32(data[a:b]) for a, b in zip(starts, ends)]
    two = resample.crc32(data, starts, ends, one)
    assert two.tolist() == [zlib.crc32(data[a:b], int(v)) for a, b, v in zip(starts, ends, one)]


def test_features_of_a_slice():
    texts = ["Dog's CAT-naïve 9 9", "", "Ünï", "x" * 500 + " y"]
    column = vec.pa.array(texts)
    (part,) = vec.slices(column)
    found = resample.features(part)
    assert found.words.tolist() == [len(words_of(t)) for t in texts]
    for row, text in enumerate(texts):
        assert sorted(found.buckets[found.rows == row].tolist()) == sorted(buckets_of(text))


def test_real_documents_match_brute_force(spark):
    docs, items = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "benchmark")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [r["text"] for r in items.collect()])
    assert ours(docs, items) == want and any(r[4] for r in want)


def test_awkward_rows_match_brute_force(spark):
    ready(spark)
    docs = cases.awkward(spark).unionByName(
        spark.createDataFrame([(-5 * k, cases.text_of(25 + k, k)) for k in range(1, 40)], "doc_id long, text string"),
        allowMissingColumns=True,
    )
    items = spark.createDataFrame([(cases.text_of(300, 2),), (None,), ("",)], "text string")
    got, want = ours(docs, items), brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [r[0] for r in items.collect()])
    assert got == want
    assert resample.resample(cases.empty(spark), items).count() == 0
    assert resample.resample(docs, items.limit(0)).count() == docs.count()


@pytest.mark.parametrize("bits", [(1, 1), (3, 3), (10, 18)])
def test_radix_sort_by_several_keys(spark, monkeypatch, bits):
    monkeypatch.setattr(resample, "BLOCK_BITS", bits)
    monkeypatch.setattr(resample, "DIGIT_BITS", 5)
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b), k) for k, (a, b) in enumerate(zip(rng.integers(0, 60, 400), rng.integers(-(2**63), 2**63, 400)))]
    rows += [(7, -1, 400 + k) for k in range(100)]  # one key for many rows
    frame = written(spark.createDataFrame(rows, "a long, b long, n long"), "rows")
    got = resample.radix_sort(frame, ["a", "b"]).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(500))
    assert [(r["a"], r["b"]) for r in got] == sorted([r[:2] for r in rows], key=lambda r: (r[0], r[1] % 2**64))
    assert resample.radix_sort(frame.limit(0), ["a"]).count() == 0
