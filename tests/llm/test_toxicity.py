import itertools

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.llm import char_model, toxicity, vec
from lotwise.llm.common import ready, table
from lotwise.llm.lattice import Restorer, core, is_disguised, is_doubtful, readings, with_end_marks


@pytest.fixture(scope="module")
def model(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    return char_model.train(docs.select("text"), fold_case=True)


def test_restores_disguised_words(model):
    tool = Restorer(model)
    for shown, word in [("id1ot", "idiot"), ("m0ron", "moron"), ("t.r.a.s.h", "trash"), ("stuuuupid", "stupid"),
                        ("worth-less", "worthless"), ("cl0wn", "clown"), ("p@thetic", "pathetic")]:
        assert is_disguised(shown)
        assert tool.restore(shown) == word


def test_viterbi_finds_the_best_path(model):
    tool = Restorer(model)

    def cost(path):
        at, total = sum(1 << (6 * k) for k in range(3)), 0.0
        for letters, price in path:
            total += price
            for letter in letters:
                at, more = tool._step(at, letter)
                total += more
        return total + tool._step(at, " ")[1]

    for text in ["t3st.1", "a1!o", "aaab0", "x y z", "$h*t"]:
        paths = list(itertools.product(*readings(text)))
        best = max(map(cost, paths))
        assert tool.restore(text) in {"".join(p[0] for p in path) for path in paths if cost(path) > best - 1e-9}


def test_core_strips_marks_only():
    assert core("Idiot!!") == "idiot" and core("(that***") == "that" and core("$tupid,") == "$tupid"
    assert not is_disguised("plain") and not is_disguised("2024") and is_disguised("i.d")


def test_learns_and_scores_the_held_out_fold(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    rows = toxicity.predict(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 1000
    clean = [r for r in rows if not r["toxic"]]
    toxic = [r for r in rows if r["toxic"]]
    assert sum(r["predicted"] for r in clean) <= 0.01 * len(clean)
    assert sum(r["predicted"] for r in toxic) >= 0.75 * len(toxic)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_disguised_toxic_texts_are_caught(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    base = "The and attion to thanedble the anea eriner thanea then edinth is thndor thonndon ernd reer thor"
    hidden = ["an id1ot and a m0ron", "what i d i o t and tra$h", "you stuuuupid p@thetic clown", "t.r.a.s.h and s-c-u-m"]
    planted = [(10_000_000 + k, f"{base} {h} of er for") for k, h in enumerate(hidden)] + [(10_000_100, base)]
    more = spark.createDataFrame(planted, "doc_id long, text string")
    scored = toxicity.predict(docs.select("doc_id", "text").unionByName(more), labels)
    got = {r["doc_id"]: r for r in scored.filter("doc_id >= 10000000").collect()}
    assert all(got[10_000_000 + k]["predicted"] == 1 for k in range(len(hidden)))
    assert got[10_000_100]["predicted"] == 0


def test_held_out_labels_are_never_used(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    turned = labels.withColumn("toxic", F.when(fold == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (sorted(map(tuple, toxicity.predict(docs, t).collect())) for t in (labels, turned))
    assert one == two


def test_awkward_rows(spark):
    docs = cases.awkward(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    got = cases.by_id(toxicity.predict(docs, labels).collect())
    assert sum(map(len, got.values())) == docs.count()
    assert got[3][0]["score"] == got[4][0]["score"] and not got[None][0]["held_out"]
    assert got[1][0] == got[1][1]
    kept = toxicity.keep(docs, labels)
    assert kept.columns == docs.columns
    ready(spark)
    assert toxicity.predict(cases.empty(spark), labels).count() == 0
    assert toxicity.predict(docs, labels.limit(0)).count() == docs.count()


def test_spaced_runs_stay_within_a_text():
    import pyarrow as pa

    part = next(vec.slices(pa.array(["a b", "c d e x1", "f"])))
    words, _ = vec.word_hashes(part)
    assert list(toxicity.Reader._spaced(part, words)) == [(1, "c d e")]
    assert np.array_equal(np.bincount(words.rows), [2, 4, 1])


def test_restores_end_marks_doubled_letters_and_fragments(model):
    tool = Restorer(model)
    for shown, word in [("!diot", "idiot"), ("(lown", "clown"), ("+rash", "trash"), ("idio+,", "idiot"),
                        ("iidiott", "idiot"), ("stuupid", "stupid"), ("Idiot!!", "idiot"), ("(that***", "that")]:
        text = with_end_marks(shown)
        assert is_doubtful(text) and tool.restore(text) == word
    for shown, word in [("st upid", "stupid"), ("id iot", "idiot"), ("st up id", "stupid"), ("of the", "of the")]:
        assert tool.restore(shown) == word
    assert not is_doubtful("plain") and with_end_marks('"(Lown,') == "(lown" and with_end_marks("***") == ""


def test_all_forms_of_the_channel_are_caught(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    base = "The and attion to thanedble the anea eriner thanea then edinth is thndor thonndon ernd reer thor"
    hidden = ["an !diot and a |oser", "a (lown and +rash", "what an iidiott so stuupid", "you st upid id iot", "st up id idio+"]
    planted = [(10_000_000 + k, f"{base} {h} of er for") for k, h in enumerate(hidden)] + [(10_000_100, base)]
    more = spark.createDataFrame(planted, "doc_id long, text string")
    scored = toxicity.predict(docs.select("doc_id", "text").unionByName(more), labels)
    got = {r["doc_id"]: r for r in scored.filter("doc_id >= 10000000").collect()}
    assert all(got[10_000_000 + k]["predicted"] == 1 for k in range(len(hidden)))
    assert got[10_000_100]["predicted"] == 0


def test_cutting_the_lattice_changes_no_score(spark, model):
    """Against reading every doubtful word, on real texts and on disguised ones."""

    class Whole(toxicity.Reader):
        def _may_count(self, text, inner):
            return True

        def _begins_otherwise(self, text):
            return False

    odds = {"idiot": 3.0, "stupid": 2.5, "^trash": 2.0, "loser": 1.5, "clown": 1.0, "^mor": 0.0, "thatea": 0.7, "^oner": 0.4}
    texts = [r["text"] for r in table(spark, "/root/testdata/sf0.01", "documents").limit(300).collect()]
    texts += ["an !diot st up1d id 10t +rashy (lown", "l0ser l o s e r id.i0t st uup id", "m0ron *** ! x-id-iot idiot5", "", "th@tea 0nerous"]
    cut, whole = toxicity.Reader(Restorer(model), odds), Whole(Restorer(model), odds)
    some = 0
    for part in vec.slices(vec.pa.array(texts)):
        one, two = cut.read(part), whole.read(part)
        assert np.array_equal(one.total, two.total) and np.array_equal(one.most, two.most)
        assert np.array_equal(one.evidence, two.evidence) and np.array_equal(one.words, two.words)
    for word in ["Idiot.", "'Tis,", "word", "x", "ªb?", "Straße;", '"a"', "?", "..a.b.."]:
        plain = word.lower().strip(toxicity._MARKS)
        assert not plain.isalpha() or (plain, plain) == (with_end_marks(word), core(word))
    for part in vec.slices(vec.pa.array(texts)):
        one = cut.read(part)
        some += int(one.evidence.sum())
    assert some > 10
