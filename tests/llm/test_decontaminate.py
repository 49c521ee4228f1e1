import random
import re

import cases

from lotwise.llm import decontaminate as dc
from lotwise.llm.common import ready, table


def least_edits(pattern, text):
    row = list(range(len(pattern) + 1))
    best = len(pattern)
    for char in text:
        after = [0]
        for i, own in enumerate(pattern, 1):
            after.append(min(row[i - 1] + (own != char), row[i] + 1, after[i - 1] + 1))
        row = after
        best = min(best, row[-1])
    return best


def brute(docs, items, share=dc.BUDGET):
    out = set()
    for doc_id, text in docs:
        for item_id, item in items:
            pattern = dc.normal(item or "")
            if not pattern:
                continue
            if not dc.budget_of(len(pattern), share):
                edges = [r"(?<![^\W_])" if pattern[0].isalnum() else "", r"(?![^\W_])" if pattern[-1].isalnum() else ""]
                if re.search(edges[0] + re.escape(pattern) + edges[1], dc.normal(text or "")):
                    out.add((doc_id, item_id, 0))
                continue
            distance = least_edits(pattern, dc.normal(text or ""))
            if distance <= dc.budget_of(len(pattern), share):
                out.add((doc_id, item_id, distance))
    return out


def test_myers_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(800):
        pattern = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 120)))
        assert dc.myers(dc.masks_of(pattern), len(pattern), text)[0] == least_edits(pattern, text)


def damaged(rng, text, edits):
    for _ in range(edits):
        at = rng.randrange(len(text))
        text = text[:at] + rng.choice(["", "q", text[at] + "w"]) + text[at + 1 :]
    return text


def test_planted_passages_match_brute_force(spark):
    ready(spark)
    rng = random.Random(2)
    items = [(k, cases.text_of(9, 50 + k)) for k in range(6)] + [(6, "Ab"), (7, None), (8, "  "), (9, cases.text_of(9, 50))]
    docs = []
    for k in range(60):
        item = items[k % 6][1]
        planted = damaged(rng, item, k % 9).upper() if k % 2 else damaged(rng, item, k % 9).replace(" ", "\n ")
        docs.append((k, f"{cases.text_of(6, 500 + k)} {planted} {cases.text_of(6, 600 + k)}"))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in dc.matches(*frames).collect()}
    assert got == brute(docs, items) and len(got) > 30


def test_benchmark_passages_of_the_test_data(spark):
    docs, items = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in dc.matches(docs, items).filter("distance = 0").collect()}
    normal = [(r["doc_id"], dc.normal(r["text"])) for r in docs.collect()]
    exact = {(d, r["item_id"]) for r in items.collect() for d, t in normal if dc.normal(r["text"]) in t}
    assert got == exact and exact
    left = {r["doc_id"] for r in dc.clean(docs, items).collect()}
    assert not left & {d for d, _ in exact} and len(left) + len({d for d, _ in dc_ids(docs, items)}) == docs.count()


def dc_ids(docs, items):
    return {(r["doc_id"], 0) for r in dc.matches(docs, items).collect()}


def test_items_in_several_blocks_give_the_same(spark, monkeypatch):
    docs, items = (table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, dc.matches(docs, items).collect()))
    monkeypatch.setattr(dc, "BLOCK_CHARS", 1000)
    assert sorted(map(tuple, dc.matches(docs, items).collect())) == whole and whole


def test_awkward_rows(spark):
    docs = cases.awkward(spark)
    items = spark.createDataFrame([(1, cases.text_of(30)), (1, cases.text_of(30)), (None, "zzzz qqqq"), (2, None)],
                                  "item_id long, text string")
    got = dc.matches(docs, items).collect()
    assert sorted({r["doc_id"] for r in got}) == [1, 2] and {r["distance"] for r in got} == {0}
    left = dc.clean(docs, items)
    assert left.columns == docs.columns and left.count() == docs.count() - 3
    assert dc.clean(docs, items.limit(0)).count() == docs.count()
    assert dc.matches(cases.empty(spark), items).count() == 0
    assert dc.matches(docs, items.limit(0)).count() == 0


def test_short_items_match_whole_words_only(spark):
    ready(spark)
    items = [(1, "a"), (2, "Yes"), (3, "42!"), (4, "no way"), (5, "longer answer"), (6, "!")]
    texts = ["", "plain horse bees", "Well, YES.", "yesterday", "a", "it is 42!x", "142!", "no  way, no wayne", "wow!", "a longer anser", "x-a_"]
    docs = list(enumerate(texts))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in dc.matches(*frames).collect()}
    assert got == brute(docs, items) and (1, 2, 0) not in got and {(2, 2, 0), (9, 5, 1)} <= got
    assert {r["doc_id"] for r in dc.clean(*frames).collect()} == {0, 1, 3}
