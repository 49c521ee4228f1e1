import re

import cases

from lotwise.llm import licenses
from lotwise.llm.common import ready, table

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, templates, share=licenses.CONTAINMENT):
    own, starts, base = words(text), [], set()
    for phrase, label in licenses.PHRASES.items():
        n = len(phrase.split())
        for i in range(len(own) - n + 1):
            if own[i : i + n] == phrase.split():
                starts.append(i)
                base.add(label)
    met = []
    for number, line in enumerate((text or "").split("\n")):
        block = set(words(line))
        for label, template in templates:
            wanted = set(words(template))
            if wanted and len(wanted & block) >= share * len(wanted) - 1e-9:
                met.append((number, label, round(len(wanted & block) / len(wanted), 9)))
    return (len(own), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | {m[1] for m in met})), sorted(met))


def check(spark, docs, templates=None, share=licenses.CONTAINMENT):
    rows = licenses.scan(docs, templates, share).collect()
    texts = cases.by_id(docs.select("doc_id", "text").collect())
    assert len(rows) == sum(map(len, texts.values()))
    got = cases.by_id(rows)
    for doc_id, own in texts.items():
        want = sorted((brute(r["text"], templates or licenses.TEMPLATES, share) for r in own), key=repr)
        have = sorted(
            ((r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"],
              sorted((b["line"], b["label"], round(b["containment"], 9)) for b in r["blocks"]))
             for r in got[doc_id]), key=repr)
        assert have == want
    return rows


def test_documents_match_brute_force(spark):
    rows = check(spark, table(spark, "/root/testdata/sf0.01", "documents"))
    assert any(r["n_base"] for r in rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_templates_with_common_words_match_brute_force(spark):
    """Templates made of the corpus's own words, at a low threshold, give many partial matches."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    lines = [line for r in docs.orderBy("doc_id").limit(40).collect() for line in r["text"].split("\n")]
    templates = [(f"t{k}", line) for k, line in enumerate(lines[:60]) if words(line)] + [("none", "!!")]
    rows = check(spark, docs, templates, 0.5)
    assert sum(len(r["blocks"]) for r in rows) > len(templates)


def test_batches_of_templates_give_the_same(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    whole = sorted(map(repr, licenses.scan(docs).drop("blocks").collect()))
    monkeypatch.setattr(licenses, "BATCH_WORDS", 60)
    assert sorted(map(repr, licenses.scan(docs).drop("blocks").collect())) == whole


def test_awkward_rows(spark):
    ready(spark)
    check(spark, cases.awkward(spark))
    more = [(1, "MIT\nlicense, cc-by, CC by. GNU general PUBLIC license"), (2, "é mit licenseé mit license")]
    check(spark, spark.createDataFrame(more, "doc_id long, text string"))
    assert licenses.scan(cases.empty(spark)).count() == 0
    assert licenses.scan(cases.awkward(spark), []).filter("labels <> base_labels").count() == 0


def brute_passages(text, templates, share=licenses.CONTAINMENT):
    """Labels of templates that any window of words meets."""
    own, out = words(text), set()
    for label, template in templates:
        wanted = set(words(template))
        width = -int(-(len(words(template)) / share - 1e-9) // 1)
        for i in range(len(own)):
            if wanted and len(wanted & set(own[i : i + width])) >= share * len(wanted) - 1e-9:
                out.add(label)
    return out


def labels_of(row):
    return set(filter(None, row["labels"].split(",")))


def test_wrapped_notices_are_found(spark):
    ready(spark)
    mpl = " * This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy"
    bsd = (
        "# Redistribution and use in source and binary forms, with or without\n"
        "# modification, are permitted provided that the following conditions\n# are met:\n# 1."
    )
    filler = cases.text_of(60)
    rows = [(1, mpl), (2, f"{filler}\n{bsd}\n{filler}"), (3, f"{bsd}\n\n{mpl}"), (4, licenses.TEMPLATES[9][1]),
            (5, "Mozilla Public\n" + filler + "\nLicense"), (6, None)]
    rows += [(10 + k, filler + "\n" + t.replace(" ", "\n")) for k, (_, t) in enumerate(licenses.TEMPLATES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs, wrapped=True).collect()}
    assert labels_of(got[1]) == {"mpl-2.0"} and got[1]["score"] == 1 and [b["line"] for b in got[1]["blocks"]] == [0]
    assert labels_of(got[2]) == {"bsd"} and [b["line"] for b in got[2]["blocks"]] == [1]
    assert labels_of(got[3]) == {"bsd", "mpl-2.0"}
    assert len(got[4]["blocks"]) == 1 and not got[5]["labels"] and not got[6]["blocks"]
    for k, (label, _) in enumerate(licenses.TEMPLATES):
        assert label in labels_of(got[10 + k])


def test_passages_match_brute_force(spark):
    """Notices in damaged words and random line breaks, between words of the templates."""
    import random

    ready(spark)
    rng = random.Random(3)
    pool = [w for _, t in licenses.TEMPLATES for w in t.split()]
    rows = []
    for k in range(150):
        notice = [w for w in rng.choice(licenses.TEMPLATES)[1].split() if rng.random() > 0.04]
        for _ in range(rng.randrange(3)):
            notice.insert(rng.randrange(len(notice) + 1), "more")
        around = [rng.choice(pool) for _ in range(60)]
        rows.append((k, "".join(w + rng.choice(" \n  ") for w in around[:30] + notice + around[30:])))
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), wrapped=True).collect()
    missed = 0
    for r in found:
        text = rows[r["doc_id"]][1]
        by_line = brute(text, licenses.TEMPLATES)[5].split(",")
        want = brute_passages(text, licenses.TEMPLATES) | set(filter(None, by_line))
        assert labels_of(r) == want
        missed += want != set(filter(None, by_line))
    assert missed > 30


def test_query_scans_across_lines(spark, tmp_path):
    from lotwise.llm import queries

    text = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0."
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (row,) = queries.op6_license_scan(spark, str(tmp_path)).collect()
    assert row["labels"] == "mpl-2.0"
