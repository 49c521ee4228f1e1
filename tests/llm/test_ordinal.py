import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.llm import ordinal
from lotwise.llm.common import ready, table


def test_gradient_descent_reaches_an_optimum():
    """On data of known thresholds the fitted tails come close to the true shares."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 5, 4000)
    latent = 1.5 * (x - 2) + rng.logistic(size=4000)
    grades = np.digitize(latent, [-1.0, 1.0])
    model = ordinal.fit(np.arange(4000), x.astype(np.int64), np.ones(4000), grades, 3)
    assert (np.diff(model.thresholds) > 0).all()
    tails = model.tails(model.weights[np.arange(5)])
    for k in range(5):
        assert tails[k] == pytest.approx([(grades[x == k] >= g).mean() for g in (1, 2)], abs=0.05)


def graded(spark, sf):
    docs, labels = (table(spark, f"/root/testdata/{sf}", t) for t in ("documents", "labels"))
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    ratings = labels.select("doc_id", grade.alias("grade"))
    return ordinal.grade(docs, ratings, 3), ratings


def test_held_out_grades(spark):
    got, ratings = graded(spark, "sf0.1")
    rows = got.join(ratings, "doc_id").filter("held_out").collect()
    assert len(rows) > 1000
    low, high = ([r for r in rows if (r["grade"] > 0) == side] for side in (False, True))
    assert sum(not r["kept"] for r in low) >= 0.95 * len(low)
    assert sum(r["kept"] for r in high) >= 0.99 * len(high)
    means = [np.mean([r["expected_grade"] for r in rows if r["grade"] == g]) for g in range(3)]
    assert means == sorted(means)
    for r in rows:
        assert 1 >= r["p_ge_1"] >= r["p_ge_2"] >= 0 and r["expected_grade"] == pytest.approx(r["p_ge_1"] + r["p_ge_2"])


def test_repeatable_and_blind_to_held_out_ratings(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "labels"))
    ratings = labels.select("doc_id", F.col("quality").alias("grade"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    turned = ratings.withColumn("grade", F.when(fold == 1, 1 - F.col("grade")).otherwise(F.col("grade")))
    one, two = (sorted(map(tuple, ordinal.grade(docs, t, 2).collect())) for t in (ratings, turned))
    assert one == two


def test_awkward_rows(spark):
    docs = cases.awkward(spark)
    ratings = spark.createDataFrame([(1, 2), (1, 0), (2, 1), (None, 1), (6, None)], "doc_id long, grade int")
    got = cases.by_id(ordinal.grade(docs, ratings, 3).collect())
    assert sum(map(len, got.values())) == docs.count()
    assert got[3][0]["expected_grade"] == got[4][0]["expected_grade"] and got[1][0] == got[1][1]
    ready(spark)
    assert ordinal.grade(cases.empty(spark), ratings, 3).count() == 0
    none = ordinal.grade(docs, ratings.limit(0), 3).collect()
    assert len(none) == docs.count() and none[0]["p_ge_1"] == pytest.approx(2 / 3)
