"""Worked examples and corner cases, by hand."""

import datetime as dt
from dataclasses import replace
from decimal import Decimal

import builders as b
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.functions import dates, numbers, returns
from lotwise.operators import allocate, evolution, filters, lineage, lots, quotes, resolve, valuation
from lotwise.schemas import FUND
from lotwise.session import written
from lotwise.sources import stores

ISIN = "LU0113257694"


@pytest.fixture
def bought(spark):
    """Two purchases: one by its cost, one by its shares."""
    ops = spark.createDataFrame(
        [(1, "A", b.day("2020-12-21"), None, b.dec(5000), None), (2, "A", b.day("2020-12-22"), b.dec(200), None, None)],
        "lot_id long, account_id string, trade_date date, shares decimal(18,5), cost decimal(18,2), origin_sale_id long",
    )
    empty = b.ledger(spark)
    table = resolve.resolve_subscriptions(
        ops,
        b.accounts(spark, ("A", ISIN, "Bank"), ("B", ISIN, "Other")),
        b.quotes(spark, (ISIN, "2020-12-21", 24.7623), (ISIN, "2020-12-22", 24.7444)),
        empty.sales,
        empty.lots,
    )
    return table


def test_missing_amounts_come_from_the_price(bought):
    assert b.rows(bought, "lot_id", "initial_shares", "cost") == [(1, 201.91985, 5000.0), (2, 200.0, 4948.88)]


def orders(spark, *rows):
    return spark.createDataFrame(
        [(i, "A", b.day("2020-12-23"), b.dec(n), None, None) for i, n in rows],
        "order_id long, account_id string, trade_date date, shares decimal(18,5), proceeds decimal(18,2), bought_shares decimal(18,5)",
    )


def test_sale_takes_the_oldest_lots_first(spark, bought):
    open_lots = lots.open_lots(bought, b.sales(spark))
    sold, refused = allocate.fifo_allocate_shares(orders(spark, (1, 300)), open_lots)
    assert b.rows(sold, "lot_id", "shares") == [(1, 201.91985), (2, 98.08015)]
    assert refused.isEmpty()
    sales = sold.select(F.col("lot_id").alias("sale_id"), "order_id", "lot_id", "shares", "proceeds")
    assert b.rows(lots.open_lots(bought, sales), "lot_id", "shares") == [(1, 0.0), (2, 101.91985)]


def test_too_many_shares_are_refused_and_take_nothing(spark, bought):
    open_lots = lots.open_lots(bought, b.sales(spark))
    sold, refused = allocate.fifo_allocate_shares(orders(spark, (1, 500), (2, 400)), open_lots)
    assert b.rows(refused, "order_id", "reason") == [(1, "too many shares")]
    assert b.rows(sold, "order_id", "shares") == [(2, 198.08015), (2, 201.91985)]


def test_sale_without_amount_takes_everything(spark, bought):
    sold, _ = allocate.fifo_allocate_shares(orders(spark, (1, None)), lots.open_lots(bought, b.sales(spark)))
    assert b.rows(sold, "lot_id", "shares") == [(1, 201.91985), (2, 200.0)]


def transfer_ops(spark, *rows):
    return spark.createDataFrame(
        [(i, i, lot, b.day(sell), b.dec(n), b.dec(p), to, buy and b.day(buy), None) for i, lot, sell, n, p, to, buy in rows],
        "sale_id long, order_id long, lot_id long, sell_date date, shares decimal(18,5), proceeds decimal(18,2),"
        " destination string, buy_date date, bought_shares decimal(18,5)",
    )


def test_transfers(spark, bought):
    accounts = b.accounts(spark, ("A", ISIN, "Bank"), ("B", ISIN, "Other"), ("C", "X", "Bank"))
    known = b.quotes(spark, (ISIN, "2020-12-23", 24.8))
    ops = transfer_ops(
        spark,
        (10, 1, "2020-12-23", None, None, "C", "2020-12-26"),  # waits for the price of X
        (11, 2, "2020-12-24", 50, None, "B", None),  # same fund and day: needs no price
        (12, 2, "2020-12-24", 50, None, "C", None),  # money unknown: cannot be funded
        (13, 2, "2020-12-23", 10, None, "C", "2020-12-22"),
    )
    open_lots = lots.open_lots(bought, b.sales(spark))
    sales, children = resolve.resolve_transfers(ops, bought, open_lots, accounts, known)
    assert b.rows(sales, "sale_id", "shares", "proceeds", "reason") == [
        (10, 201.91985, 5007.61, None),
        (11, 50.0, None, None),
        (12, 50.0, None, "no price for the sale"),
        (13, 10.0, 248.0, "bought before sold"),
    ]
    assert b.rows(children, "origin_sale_id", "account_id", "invest_date", "trade_date", "initial_shares", "cost") == [
        (10, "C", "2020-12-21", "2020-12-26", None, 5007.61),
        (11, "B", "2020-12-22", "2020-12-24", 50.0, None),
    ]


def test_feed_keys(spark):
    funds = b.funds(spark, (ISIN, "Bond", None, "web", True))
    feeds = b.feeds(spark, ("web", ISIN, "bond-data"))

    def update(feed, key, sets_key):
        return spark.createDataFrame([(ISIN, feed, key, sets_key)], "isin string, feed string, feed_key string, sets_key boolean")

    def view(pair):
        return b.rows(lots.fund_view(*pair), "feed", "alias", "feed_key")

    cleared = stores.upsert_fund_feed(funds, feeds, update(None, None, True))
    assert view(cleared) == [("web", "Bond", ISIN)]
    restored = stores.upsert_fund_feed(*cleared, update(None, "new-data", True))
    assert view(restored) == [("web", "Bond", "new-data")]
    assert view(stores.upsert_fund_feed(*restored, update("bank", None, False))) == [("bank", "Bond", ISIN)]
    keyed = T.StructType([*FUND.fields, T.StructField("feed_key", T.StringType())])
    added = spark.createDataFrame(
        [("N1", "New", None, None, "EUR", 2, "csv", True, "k1"), (ISIN, "Twice", None, None, "EUR", 2, "csv", True, "k2")], keyed
    )
    *both, refused = stores.insert_funds(funds, feeds, added.unionByName(added.filter("isin = 'N1'")))
    assert view(both) == [("csv", "New", "k1"), ("web", "Bond", "bond-data")]
    assert b.rows(refused, "isin", "reason") == [(ISIN, "known fund"), ("N1", "repeated fund")]


def test_last_of_several_feed_updates_holds(spark):
    funds = b.funds(spark, (ISIN, "Bond", None, "web", True))
    feeds = b.feeds(spark, ("web", ISIN, "bond-data"))
    updates = spark.createDataFrame(
        [(ISIN, "bank", "b1", True, 2), (ISIN, "csv", "c1", True, 1)], "isin string, feed string, feed_key string, sets_key boolean, number int"
    )
    changed = stores.upsert_fund_feed(funds, feeds, updates, order=["number"])
    assert b.rows(lots.fund_view(*changed), "feed", "feed_key") == [("bank", "b1")]
    first = stores.upsert_fund_feed(funds, feeds, updates.filter("number = 1"), order=["number"])
    assert b.rows(lots.fund_view(*first), "feed", "feed_key") == [("csv", "c1")]


def test_sales_of_one_lot_share_what_is_left(spark):
    accounts, quotes = b.accounts(spark, ("A", ISIN, "B0")), b.quotes(spark, (ISIN, "2020-01-02", 2))
    bought = b.lots(spark, (1, "A", "2020-01-01", "2020-01-01", 10, 100, None), (2, "A", "2020-01-01", "2020-01-01", 0, 100, None))
    ops = spark.createDataFrame(
        [(5, 5, 1, b.day("2020-01-02"), None, None), (4, 4, 1, b.day("2020-01-02"), b.dec(4), None),
         (6, 6, 1, b.day("2020-01-02"), None, None), (7, 7, 2, b.day("2020-01-02"), None, None),
         (8, 8, 1, b.day("2020-01-03"), b.dec(0), None), (9, 9, 3, b.day("2020-01-03"), b.dec(1), None)],
        "sale_id long, order_id long, lot_id long, trade_date date, shares decimal(18,5), proceeds decimal(18,2)",
    )
    open_lots = lots.open_lots(bought, b.sales(spark))
    found = {r["sale_id"]: (r["shares"] and float(r["shares"]), r["reason"]) for r in resolve.resolve_sales(ops, open_lots, accounts, quotes).collect()}
    assert found[4] == (4.0, None) and found[5] == (6.0, None)
    assert found[6][1] == found[7][1] == "nothing left"
    assert found[8][1] == "shares not positive" and found[9][1] == "unknown lot"


@pytest.fixture
def chain(spark):
    """Three hops with partial sales; half of the last lot is redeemed."""
    return b.ledger(
        spark,
        funds=b.funds(spark, ("X", "Fund X", None, None, True), ("Y", "Fund Y", "Y", None, True)),
        accounts=b.accounts(spark, ("AX", "X", "B0"), ("AY", "Y", "B0"), ("BY", "Y", "B1")),
        lots=b.lots(
            spark,
            (1, "AX", "2010-01-01", "2010-01-01", 100, 1000, None),
            (2, "AY", "2010-01-01", "2012-01-01", 40, 600, 11),
            (3, "BY", "2010-01-01", "2014-01-01", 20, 500, 12),
        ),
        orders=b.orders(spark, (21, "2012-01-01"), (22, "2014-01-01"), (23, "2015-01-01")),
        sales=b.sales(spark, (11, 21, 1, 50, 600), (12, 22, 2, 20, 500), (13, 23, 3, 10, 300)),
        quotes=b.quotes(
            spark, ("X", "2010-01-01", 10), ("X", "2016-01-01", 20), ("Y", "2012-01-01", 15),
            ("Y", "2013-06-01", 18), ("Y", "2014-01-01", 25), ("Y", "2016-01-01", 40),
        ),
    )


def test_lineage_scales_every_hop(chain):
    found = lineage.lineage(chain)
    assert b.rows(found, "terminal_lot", "order_id", "hop", "lot_id", "shares", "cost", "proceeds", "capital") == [
        (1, 0, 0, 1, 50.0, 500.0, 1000.0, 500.0),
        (2, 0, 0, 2, 20.0, 300.0, 800.0, 250.0),
        (2, 0, 1, 1, 25.0, 250.0, 300.0, 250.0),
        (3, 0, 0, 3, 10.0, 250.0, 400.0, 125.0),
        (3, 0, 1, 2, 10.0, 150.0, 250.0, 125.0),
        (3, 0, 2, 1, 12.5, 125.0, 150.0, 125.0),
        (3, 23, 0, 3, 10.0, 250.0, 300.0, 125.0),
        (3, 23, 1, 2, 10.0, 150.0, 250.0, 125.0),
        (3, 23, 2, 1, 12.5, 125.0, 150.0, 125.0),
    ]
    only = lineage.lineage(chain, redeemed=True)
    assert b.rows(only, "lot_id") == b.rows(filters.filter_lineage(found, redeemed=True), "lot_id")
    assert b.rows(lineage.fiscal_gains(only), "gain", "origin_lot") == [(175.0, 1)]


def test_circle_of_transfers_is_an_error(spark):
    tables = b.ledger(
        spark,
        accounts=b.accounts(spark, ("A", "X", "B0")),
        lots=b.lots(spark, (1, "A", "2010-01-01", "2010-01-01", 10, 10, 12), (2, "A", "2010-01-01", "2010-01-02", 10, 10, 11)),
        orders=b.orders(spark, (1, "2010-01-02"), (2, "2010-01-03")),
        sales=b.sales(spark, (11, 1, 1, 5, 5), (12, 2, 2, 5, 5)),
        quotes=b.quotes(spark, ("X", "2010-01-01", 1)),
    )
    with pytest.raises(ValueError):
        lineage.lineage(tables)


def test_portfolio_between_dates(spark, chain):
    hops = lineage.lineage(chain)
    # Lot 3 is a change of distributor, so its capital is that of lot 2.
    plain = valuation.portfolio_between(hops, chain)
    assert b.rows(plain, "account_id", "prior_gain", "capital", "shares", "valuation") == [
        ("AX", 0.0, 500.0, 50.0, 1000.0),
        ("AY", 50.0, 300.0, 20.0, 800.0),
        ("BY", 25.0, 150.0, 10.0, 400.0),
    ]
    # From mid 2013 on the capital is the value on that day; X has no later quote before 2016.
    since = valuation.portfolio_between(hops, chain, b.day("2013-06-01"))
    assert b.rows(since, "account_id", "prior_gain", "capital") == [
        ("AX", 0.0, 1000.0), ("AY", 0.0, 360.0), ("BY", 0.0, 180.0)
    ]
    until = valuation.portfolio_between(hops, chain, None, b.day("2013-12-31"))
    assert b.rows(until, "account_id", "shares", "nav") == [("AX", 50.0, 10.0), ("AY", 30.0, 18.0)]


def test_two_purchases_and_an_early_end(spark):
    """Purchases after the end are left out; those before the start are re-based."""
    tables = b.ledger(
        spark,
        accounts=b.accounts(spark, ("A", "X", "B0")),
        lots=b.lots(spark, (1, "A", "2010-01-01", "2010-01-01", 10, 100, None), (2, "A", "2015-01-01", "2015-01-01", 10, 200, None)),
        quotes=b.quotes(spark, ("X", "2010-01-01", 10), ("X", "2012-01-01", 14), ("X", "2015-01-01", 20), ("X", "2020-01-01", 30)),
    )
    hops = lineage.lineage(tables)

    def capital(start, end):
        result = valuation.portfolio_between(hops, tables, start and b.day(start), end and b.day(end))
        return b.rows(result, "capital", "shares", "valuation")

    assert capital(None, None) == [(300.0, 20.0, 600.0)]
    assert capital(None, "2013-01-01") == [(100.0, 10.0, 140.0)]
    assert capital("2012-01-01", None) == [(340.0, 20.0, 600.0)]


def test_fund_without_quotes_and_zero_capital(spark):
    tables = b.ledger(
        spark,
        accounts=b.accounts(spark, ("A", "X", "B0"), ("Z", "Y", "B0")),
        lots=b.lots(spark, (1, "A", "2010-01-01", "2010-01-01", 10, 100, None), (2, "Z", "2010-01-01", "2010-01-01", 10, 0, None)),
        quotes=b.quotes(spark, ("Y", "2010-01-01", 5)),
    )
    assert b.rows(valuation.portfolio(tables), "isin", "valuation", "gain") == [("X", None, None), ("Y", 50.0, None)]
    assert b.rows(valuation.portfolio_between(lineage.lineage(tables), tables), "account_id") == [("Z",)]


def test_evolution_of_one_holding(spark):
    tables = b.ledger(
        spark,
        accounts=b.accounts(spark, ("A", "X", "B0")),
        lots=b.lots(spark, (1, "A", "2020-01-01", "2020-01-01", 10, 100, None)),
        quotes=b.quotes(spark, ("X", "2020-01-01", 10), ("X", "2020-01-07", 11), ("X", "2020-01-08", 12), ("X", "2020-01-20", 13)),
    )
    found = evolution.evolution(lineage.lineage(tables), tables.lots, tables.quotes, "weeks", b.day("2020-01-15"))
    series = found.filter("terminal_lot IS NOT NULL")
    assert b.rows(series, "date", "value", "cost") == [
        ("2020-01-01", 100.0, 100.0), ("2020-01-08", 120.0, 100.0), ("2020-01-20", 130.0, 100.0)
    ]
    axis = filters.filter_evolution(found, terminal_lot=False)
    assert b.rows(axis, "date") == [("2020-01-01",), ("2020-01-08",), ("2020-01-15",), ("2020-01-22",)]
    assert b.rows(evolution.axis_ticks(found), "tick") == []


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_truncation_is_exact(spark):
    for text, expected in (("0.123456", "0.12345"), ("0.12345", "0.12345"), ("200", "200"), ("1.999999", "1.99999")):
        assert one(spark, numbers.trunc5(F.lit(Decimal(text)))) == Decimal(expected)


def test_bucket_arithmetic_follows_the_steps(spark):
    start = dt.date(2020, 1, 31)
    for period in (dates.WEEKS, dates.MONTHS):
        ends = [one(spark, dates.bucket_end(F.lit(start), F.lit(k), period)) for k in range(6)]
        if period == dates.MONTHS:
            assert [str(e) for e in ends[:3]] == ["2020-01-31", "2020-02-29", "2020-03-31"]
        days = spark.range(int((ends[-1] - start).days) + 1).select(
            F.date_add(F.lit(start), F.col("id").cast("int")).alias("date")
        )
        for row in days.select("date", dates.bucket_number(F.col("date"), F.lit(start), period).alias("k")).collect():
            assert row["k"] == next(k for k, closing in enumerate(ends) if row["date"] <= closing)
        end = dt.date(2020, 3, 31)
        steps = [start]
        while steps[-1] <= end:
            steps.append(one(spark, dates.bucket_end(F.lit(start), F.lit(len(steps)), period)))
        assert dates.last_bucket(start, end, period) == len(steps) - 1


@pytest.mark.parametrize(
    "moment, expected",
    [("2021-04-14 21:59:00", "2021-04-13"), ("2021-04-14 22:00:00", "2021-04-14"), ("2021-04-17 23:00:00", "2021-04-16"),
     ("2021-04-12 09:00:00", "2021-04-09")],
)
def test_expected_quote_date(spark, moment, expected):
    found = one(spark, dates.expected_quote_date(F.lit(dt.datetime.fromisoformat(moment))))
    assert str(found) == expected


def test_annualised_return_and_tax(spark):
    def yearly(gain, days):
        return one(spark, returns.annualised(F.lit(gain).cast("double"), F.lit(100.0), F.lit(days).cast("int")))

    assert abs(yearly(10, 365) - 10) < 1e-9
    assert yearly(0, 0) == 0 and yearly(10, 0) is None and yearly(10, None) is None
    rates = [one(spark, returns.tax_rate(F.lit(gain))) for gain in (5999, 6000, 50000, 50001)]
    assert rates == [Decimal("0.19"), Decimal("0.21"), Decimal("0.21"), Decimal("0.23")]


def test_short_history_compares_with_itself(spark):
    known = b.quotes(spark, ("X", "2020-01-01", 10), ("X", "2020-01-02", 9))
    assert b.rows(quotes.quote_history(known, "X"), "date", "change_percent", "sign") == [
        ("2020-01-01", 0.0, "+"), ("2020-01-02", -10.0, "-")
    ]
    assert b.rows(quotes.quote_history(known, "X", 1), "date") == [("2020-01-02",)]


def long_chain(spark, hops, circle=False, whole=False):
    """Lot k is sold, whole or every other time a third of it, to buy lot k + 1."""
    first = None if not circle else hops - 1
    return b.ledger(
        spark,
        accounts=b.accounts(spark, ("A", ISIN, "B0")),
        quotes=b.quotes(spark, (ISIN, "2020-01-02", 2)),
        lots=b.lots(spark, *[(k, "A", "2020-01-01", "2020-01-01", 3, 100, k - 1 if k else first) for k in range(hops)]),
        orders=b.orders(spark, (1, "2020-01-01")),
        sales=b.sales(spark, *[(k, 1, k, 3 if whole or k % 2 else 1, 100) for k in range(hops if circle else hops - 1)]),
    )


def test_a_chain_of_many_thousand_hops(spark):
    found = written(lineage.lineage(long_chain(spark, 11_000, whole=True)), "chain")
    assert found.filter("terminal_lot = 10999").count() == 11_000
    assert found.filter("terminal_lot = 10999").agg(F.max("hop"), F.max("origin_lot"), F.min("origin_lot")).first()[:] == (10_999, 0, 0)


def test_fractions_are_rounded_from_hop_to_hop(spark):
    hops = [r["fraction"] for r in lineage.lineage(long_chain(spark, 6)).filter("terminal_lot = 5").orderBy("hop").collect()]
    expected = [Decimal(1)]
    for k in range(4, -1, -1):
        part = Decimal(1) if k % 2 else Decimal("0.333333333333")
        expected.append((expected[-1] * part).quantize(Decimal("0.000000000001")))
    assert hops == expected


def test_a_circle_of_transfers_is_told(spark):
    ledger = long_chain(spark, 5, circle=True)
    ledger = replace(ledger, lots=ledger.lots.unionByName(b.lots(spark, (9, "A", "2020-01-01", "2020-01-01", 3, 100, 2))))
    with pytest.raises(ValueError, match="circle"):
        lineage.lineage(ledger)


def test_sampled_rows_are_not_dealt_out_again(spark):
    """Hops are exploded above the last exchange, also where nothing is broadcast."""
    held = b.lots(spark, (1, "A1", "2020-01-05", "2020-01-05", 10, 100, None))
    prices = b.quotes(spark, ("F1", "2020-01-05", 10), ("F1", "2020-06-30", 12))
    fund = b.accounts(spark, ("A1", "F1", "B0"))
    ledger = b.ledger(spark, lots=held, accounts=fund, quotes=prices)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        series = evolution.evolution(lineage.lineage(ledger), held, prices, "months", b.day("2020-07-31"))
        plan = series._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.index("Generate explode") < plan.index("Exchange")
    assert series.filter("terminal_lot = 1").count() == 2


def test_sales_are_looked_up_once_for_all_chains(spark, monkeypatch):
    """Ends of chains and the walk share one written table of sold lots."""
    held = b.lots(
        spark,
        (1, "A1", "2020-01-05", "2020-01-05", 10, 100, None),
        (2, "A2", "2020-01-05", "2020-02-05", 5, 60, 11),
    )
    sold = b.sales(spark, (11, 21, 1, 5, 60), (12, 22, 1, 5, 70))
    orders = b.orders(spark, (21, "2020-02-05"), (22, "2020-03-05"))
    fund = b.accounts(spark, ("A1", "F1", "B0"), ("A2", "F1", "B1"))
    ledger = b.ledger(spark, lots=held, sales=sold, orders=orders, accounts=fund)
    views = []
    monkeypatch.setattr(lineage, "sale_view", lambda *given: views.append(1) or lots.sale_view(*given))
    found = lineage.lineage(ledger)
    assert b.rows(found, "terminal_lot", "order_id", "hop", "lot_id") == [(1, 22, 0, 1), (2, 0, 0, 2), (2, 0, 1, 1)]
    assert len(views) == 1


def test_lots_meet_their_account_once(spark, chain, monkeypatch):
    """Holdings and sales read one written table of lots with their fund."""
    names = []
    monkeypatch.setattr(lineage, "written", lambda frame, name: names.append(name) or written(frame, name))
    assert lineage.lineage(chain).count() == 9
    assert names.count("owned") == 1
