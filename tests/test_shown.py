"""Series as the queries show them: days as text and amounts as doubles, converted before they are repeated."""

import builders as b
import pytest
from pyspark.sql import functions as F

from lotwise.functions.numbers import exact_product, units
from lotwise.operators.evolution import evolution
from lotwise.operators.lineage import lineage
from lotwise.schemas import NAV, SHARES, VALUE

QUOTED = [f"2000-{month:02d}-{day:02d}" for month in range(1, 13) for day in (3, 17)]


@pytest.fixture(scope="module")
def market(spark):
    """Small, large and unknown numbers of shares, a sale, a lot bought on a day without a quote, and a fund without value."""
    prices = [("F", day, 1 + k / 7) for k, day in enumerate(QUOTED)] + [("G", day, "99999999.9999") for day in QUOTED]
    return b.ledger(
        spark,
        accounts=b.accounts(spark, ("a", "F", "B"), ("g", "G", "B"), ("z", "Z", "B")),
        quotes=b.quotes(spark, *prices, *[("Z", day, 0) for day in QUOTED]),
        lots=b.lots(
            spark,
            (1, "a", "2000-01-03", "2000-01-03", "3.33333", "10.01", None),
            (2, "a", "2000-02-05", "2000-02-05", "0.00001", "0.01", None),
            (3, "g", "2000-01-03", "2000-01-03", "999999.99999", "5", None),
            (4, "g", "2000-03-04", "2000-03-04", "1000000.00003", None, None),
            (5, "z", "2000-01-05", "2000-01-05", "7", "7", None),
        ),
        orders=b.orders(spark, (1, "2000-08-20")),
        sales=b.sales(spark, (1, 1, 1, "1.11111", "4")),
    )


@pytest.mark.parametrize("period", ["weeks", "months"])
def test_shown_series_are_the_series_converted(spark, market, period):
    args = lineage(market), market.lots, market.quotes, period, b.day("2000-12-20")
    plain, shown = evolution(*args), evolution(*args, shown=True)
    days, amounts = ["trade_date", "end_date", "date"], ["cost", "shares", "value"]
    converted = plain.withColumns({c: F.col(c).cast("string") for c in days} | {c: F.col(c).cast("double") for c in amounts})
    assert shown.schema.simpleString() == converted.schema.simpleString()
    expected, got = (sorted(map(str, frame.collect())) for frame in (converted, shown))
    assert got == expected and len(got) > 60


def test_exact_product_is_the_nearest_double(spark):
    pairs = [("0.00001", "0.0001"), ("-3.33333", "1.1429"), ("9999999999999.99999", "99999999.9999"), ("0", "-5"), ("671.08865", "13421.7729"),
             ("90071992547.40992", "0.0001"), ("90071992547.40993", "0.0001"), ("9007199254740.99201", "0"), (None, "1")]
    rows = spark.createDataFrame([(b.dec(s), b.dec(n)) for s, n in pairs], "s decimal(18,5), n decimal(12,4)")
    worth = (F.col("s") * F.col("n")).cast(VALUE).cast("double")
    fast = exact_product(units(F.col("s"), SHARES), units(F.col("n"), NAV), 9, worth)
    for row in rows.select(worth.alias("expected"), fast.alias("got")).collect():
        assert str(row["got"]) == str(row["expected"])
