import random
import re
from collections import defaultdict

import cases
import numpy as np
import pytest

from lotwise.llm import near_dups
from lotwise.llm.common import ready, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(text or "")
    if 0 < len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(docs):
    """class_id, n_links and n_copies by comparing every two different texts that share a shingle."""
    texts = defaultdict(list)
    for doc_id, text in docs:
        texts[text or ""].append(doc_id)
    names = list(texts)
    sets = [shingles(t) for t in names]
    holders = defaultdict(list)
    for i, own in enumerate(sets):
        for s in own:
            holders[s].append(i)
    links = set()
    for own in holders.values():
        links |= {(a, b) for a in own for b in own if a < b}
    links = {(a, b) for a, b in links if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-12}
    parent = list(range(len(names)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
        parent[max(root(a), root(b))] = min(root(a), root(b))
    members = defaultdict(list)
    for i, name in enumerate(names):
        members[root(i)] += texts[name]
    return {
        (doc_id, name): (min(members[root(i)]), count[i], len(texts[name]))
        for i, name in enumerate(names)
        for doc_id in texts[name]
    }


def near_copies(seed=5, groups=12, size=30):
    """Groups of texts that differ in a few words, so that similarities lie on both sides of the threshold."""
    rng, out = random.Random(seed), []
    for g in range(groups):
        words = cases.text_of(120, 100 + g).split()
        for k in range(size):
            own = list(words)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
            out.append((g * 1000 + k, " ".join(own)))
    return out


def compared(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = near_dups.join(frame).collect()
    assert len(rows) == len(docs)
    return {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in rows}


def test_real_documents_match_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    got = compared(spark, docs)
    assert {k[0]: v for k, v in brute(docs).items()} == got


def test_near_copies_match_brute_force(spark):
    ready(spark)
    docs = near_copies()
    got, want = compared(spark, docs), {k[0]: v for k, v in brute(docs).items()}
    links, found = (sum(v[1] for v in side.values()) for side in (want, got))
    assert links > 1000 and found >= 0.99 * links and all(got[d][1] <= want[d][1] for d in want)
    assert {d: v[0] for d, v in got.items()} == {d: v[0] for d, v in want.items()}


def test_a_large_node_is_cut_into_blocks(spark, monkeypatch):
    ready(spark)
    monkeypatch.setattr(near_dups, "BLOCK", 50)
    docs = [(k, " ".join(cases.text_of(300, 7).split() + [f"end{k}"])) for k in range(170)]
    got = compared(spark, docs)
    assert all(v == (0, len(docs) - 1, 1) for v in got.values())


def test_a_chain_is_one_class(spark):
    ready(spark)
    words = cases.text_of(200, 11).split()
    docs = []
    for k in range(40):
        docs.append((k, " ".join(words)))
        words = words[:]
        words[4 * k + 4] = f"step{k}"
    got, want = compared(spark, docs), brute(docs)
    assert {v[0] for v in got.values()} == {v[0] for v in want.values()} == {0}


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 1000).astype(np.uint64)
    other = np.concatenate([base[:800], rng.integers(0, 2**63, 200).astype(np.uint64)])
    marks = near_dups.signatures(np.concatenate([base, other]), np.repeat([0, 1], 1000), 2)
    assert abs((marks[0] == marks[1]).mean() - 800 / 1200) < 0.2


def test_estimated_recall_falls_with_depth():
    bins = [5] * near_dups.BINS
    values = [near_dups.estimated_recall(bins, d) for d in range(1, near_dups.DEPTH + 1)]
    assert values == sorted(values, reverse=True) and near_dups.estimated_recall([0] * near_dups.BINS, 6) == 1


def test_awkward_rows_and_keeping_one(spark):
    docs = cases.awkward(spark)
    got = cases.by_id(near_dups.join(docs).collect())
    assert sum(map(len, got.values())) == docs.count()
    assert got[1][0]["n_copies"] == 3 and got[2][0]["class_id"] == 1 and got[1][0]["n_links"] == 0
    assert got[3][0]["class_id"] == got[4][0]["class_id"] == 3  # null and empty texts are equal
    kept = near_dups.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 5, 6, 7, 8, 9, 9]
    assert near_dups.join(cases.empty(spark)).count() == 0
    assert near_dups.keep_one(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("edges", [[(2, 1), (3, 2), (9, 8), (5, 4), (4, 3)], [(k + 1, k) for k in range(30)]])
def test_components(spark, edges):
    got = {r["id"]: r["label"] for r in near_dups.components(spark.createDataFrame(edges, "id long, root long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert all(got.get(x, x) == label[x] for x in label)
