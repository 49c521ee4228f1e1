import random
import re
from collections import defaultdict

import cases
import numpy as np
import pytest

from lotwise.llm import near_dedup, vec
from lotwise.llm.common import ready, table

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if 0 < len(words) < 4:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 4]) for i in range(len(words) - 3))


def brute(docs):
    """(doc_id, n_shingles, component_id, kept) rows by comparing all documents that share a shingle."""
    sets = [shingles(text) for _, text in docs]
    holders, parent = defaultdict(list), list(range(len(docs)))
    for i, own in enumerate(sets):
        for s in own:
            holders[s].append(i)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in {(a, b) for own in holders.values() for b in own for a in own if a < b}:
        common = len(sets[a] & sets[b])
        if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            parent[root(b)] = root(a)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    rows = []
    for i, (doc_id, _) in enumerate(docs):
        component = least.get(root(i)) if sets[i] else doc_id
        rows.append((doc_id, len(sets[i]), component, doc_id == component))
    return sorted(rows, key=repr)


def ours(spark, docs):
    if isinstance(docs, list):
        docs = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted(map(tuple, near_dedup.deduplicate(docs).collect()), key=repr)


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def near_copies(groups=12, size=30, edits=6, length=120):
    """Groups of texts whose similarities lie on both sides of the threshold."""
    rng, out = random.Random(5), []
    for g in range(groups):
        words = cases.text_of(length, 100 + g).split()
        out += [(g * 1000 + k, edited(words, rng.randint(0, edits), rng)) for k in range(size)]
    return out


def test_real_documents_match_brute_force(spark):
    docs = [tuple(r) for r in table(spark, SF_DIR, "documents").select("doc_id", "text").collect()]
    assert ours(spark, docs) == brute(docs)


def test_near_copies_match_brute_force(spark):
    ready(spark)
    docs = near_copies()
    assert ours(spark, docs) == brute(docs)


def test_members_that_no_leader_reaches_meet_in_blocks(spark, monkeypatch):
    """Small fans and blocks, one leader: much is left to pure and mixed blocks."""
    ready(spark)
    for name, value in (("LEADERS", 1), ("JUMPS", 0), ("FAN", 7), ("BLOCK", 6), ("BANDS", 40), ("BAND_VALUES", 3)):
        monkeypatch.setattr(near_dedup, name, value)
    docs = near_copies(4, 60, 12, 100)
    assert ours(spark, docs) == brute(docs)


def test_a_large_group_is_one_component(spark):
    ready(spark)
    words, rng = cases.text_of(300, 7).split(), random.Random(2)
    docs = [(k, edited(words, 2, rng)) for k in range(600)] + [(1000 + k, " ".join(words).upper()) for k in range(300)]
    assert {r[2] for r in ours(spark, docs)} == {0}


def test_a_chain_is_one_component(spark):
    ready(spark)
    words, docs = cases.text_of(200, 11).split(), []
    for k in range(25):
        docs.append((k, " ".join(words)))
        words = words[:]
        words[4 * k + 4] = f"step{k}"
    assert ours(spark, docs) == brute(docs)


def test_awkward_rows(spark):
    docs = cases.awkward(spark)
    assert ours(spark, docs) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert near_dedup.deduplicate(cases.empty(spark)).count() == 0
    short = [(1, "A b"), (2, "a  B\n"), (3, "a b c"), (4, "b a"), (5, None), (6, "")]
    assert ours(spark, short) == brute(short)


def test_pruning_keeps_links_and_drops_unlike_pairs():
    rng = np.random.default_rng(4)

    def agreeing(similarity, n=20_000):
        left = rng.integers(0, 2**16, (n, near_dedup.VALUES)).astype(">u2")
        right = np.where(rng.random(left.shape) < similarity, left, left + 1)
        return len(near_dedup._alive(left, right)) / n

    assert agreeing(0.8) > 0.999 and agreeing(0.9) == 1 and agreeing(0.5) < 0.02 and agreeing(0.1) == 0
    assert near_dedup.least_matches() == sorted(near_dedup.least_matches())


def test_sets_of_a_slice():
    texts = ["a b c d e", "", "A b", "x y z x y z x y z"]
    (part,) = vec.slices(vec.pa.array(texts))
    _, rows = near_dedup.shingle_sets(part)
    assert np.bincount(rows, minlength=4).tolist() == [len(shingles(t)) for t in texts]


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_near_dedup"])
def test_same_rows_as_sql(spark, name):
    import compare

    from lotwise.llm import queries

    got = compare.spark_rows(queries.QUERIES[name](spark, SF_DIR))
    assert compare.difference(got, compare.oracle_rows(SF_DIR, queries.ORACLE_SQL[name])) is None
