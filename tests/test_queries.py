"""Every registered query against its SQL twin on the smallest data set."""

import compare
import pytest
from compare import SF_DIR

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    ours = compare.spark_rows(QUERIES[name](spark, SF_DIR))
    assert compare.difference(ours, compare.oracle_rows(SF_DIR, SQL[name])) is None


def test_entry_gives_a_portfolio(spark):
    weights = [row["weight"] for row in entry.entry(spark).collect()]
    assert abs(sum(weights) - 1) <= 1e-4 * len(weights)
