import cases
import compare
import public_tokenizers
import pytest
import sentencepiece
from test_decontaminate import brute as leaks
from test_near_dups import brute as classes

import corpus_pipeline
from lotwise.llm import quality, queries, toxicity
from lotwise.llm.common import table, written

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before and after every stage."""
    docs, out = table(spark, SF_DIR, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, SF_DIR), "stage")
        out[name] = (docs, after)
        docs = after
    return out


def ids(frame):
    return sorted(r["doc_id"] for r in frame.select("doc_id").collect())


def test_columns_stay_and_rows_only_go(stages):
    for name, (before, after) in stages.items():
        assert set(ids(after)) <= set(ids(before)) and after.count() > 0.7 * before.count()
        if name != "encoding":
            assert after.columns == before.columns and after.subtract(before).count() == 0


def test_toxicity_stage(spark, stages):
    before, after = stages["toxicity"]
    scored = toxicity.predict(before, table(spark, SF_DIR, "labels"))
    assert ids(after) == ids(scored.filter("predicted = 0"))


def test_quality_stage(stages):
    before, after = stages["quality"]
    assert ids(after) == ids(quality.judge(before).filter("kept"))


def test_near_duplicate_stage(stages):
    before, after = stages["near_duplicates"]
    found = classes([(r["doc_id"], r["text"]) for r in before.collect()])
    assert ids(after) == sorted({v[0] for v in found.values()})


def test_decontamination_stage(spark, stages):
    before, after = stages["decontamination"]
    items = [tuple(r) for r in table(spark, SF_DIR, "benchmark").select("item_id", "text").collect()]
    gone = set(ids(before)) - set(ids(after))
    docs = [(r["doc_id"], r["text"]) for r in before.collect()]
    for doc_id, text in docs:
        normal = " ".join(text.lower().split())
        if doc_id in gone:
            likely = sorted(items, key=lambda i: " ".join(i[1].lower().split()) not in normal)
            assert any(leaks([(doc_id, text)], [item]) for item in likely)
        else:
            assert not any(" ".join(i.lower().split()) in normal for _, i in items)


def test_encoding_stage(stages):
    before, after = stages["encoding"]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        assert r["ids"] == library.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) == len(r["ends"])


def test_run_applies_all_stages(spark, stages):
    assert ids(corpus_pipeline.run(spark, SF_DIR)) == ids(stages["encoding"][1])


def test_stages_take_awkward_rows(spark):
    docs = cases.awkward(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, "/root/testdata/sf0.001"), "stage")
    none = cases.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        none = written(stage(spark, none, "/root/testdata/sf0.001"), "stage")
    assert none.count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    ours = compare.spark_rows(queries.QUERIES[name](spark, SF_DIR))
    assert compare.difference(ours, compare.oracle_rows(SF_DIR, queries.ORACLE_SQL[name])) is None
