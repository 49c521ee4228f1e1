"""Tiered running totals equal plain windows."""

import random

import pytest
from builders import rows

from lotwise.operators import running as rn


@pytest.fixture
def skewed(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", rng.choice([None, *range(5)]), i, rng.randrange(-9, 99)) for i in range(600)]
    return spark.createDataFrame(data, "key string, day int, id long, value long")


@pytest.mark.parametrize("inclusive", [True, False])
def test_totals_equal_a_plain_loop(skewed, inclusive, monkeypatch):
    monkeypatch.setattr(rn, "ID_BLOCK_BITS", 4)
    blocked = skewed.withColumn("block", rn.id_block("id"))
    totals = {"total": ("sum", "value"), "top": ("max", "value")}
    found = rows(rn.running(blocked, ["key"], [["day"], ["block"]], ["id"], totals, inclusive))
    expected, seen = [], {}
    for key, day, i, value, block in sorted(blocked.collect(), key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2])):
        before = seen.setdefault(key, [])
        known = [*before, value] if inclusive else list(before)
        expected.append((key, day, i, value, block, sum(known), max(known, default=None)))
        before.append(value)
    assert found == rows(skewed.sparkSession.createDataFrame(expected, "key string, day int, id long, value long, block long, total long, top long"))


def test_dense_numbers_over_the_whole_table(skewed):
    numbered = rn.row_numbers(skewed, [], [["day"]], ["id"], "n")
    found = [r["n"] for r in numbered.orderBy("day", "id").collect()]
    assert found == list(range(1, 601))


def test_neighbours_across_block_edges(spark, monkeypatch):
    monkeypatch.setattr(rn, "ID_BLOCK_BITS", 2)
    data = spark.createDataFrame([("a", n) for n in range(1, 20)], "key string, n long")
    linked = rn.with_neighbours(data, "key", "n", {"before": "n"}, {"after": "n"})
    found = linked.orderBy("n").collect()
    assert [r["before"] for r in found] == [None, *range(1, 19)]
    assert [r["after"] for r in found] == [*range(2, 20), None]


def test_numbers_of_a_whole_table_are_written_and_read_without_an_exchange(skewed):
    numbered = rn.row_numbers(skewed, [], [["day"]], ["id"], "n")
    assert "Exchange" not in numbered._jdf.queryExecution().executedPlan().toString()
    assert rn.row_numbers(skewed.limit(0), [], [["day"]], ["id"], "n").collect() == []
