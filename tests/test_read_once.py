"""Tables that a step reads several times are written before, so that what made them runs once."""

import builders
from builders import accounts, dec, day, quotes, rows

from lotwise.operators.allocate import fifo_allocate_lots, fifo_allocate_shares
from lotwise.operators.evolution import axis_ticks
from lotwise.operators.lineage import lineage
from lotwise.operators.resolve import resolve_sales, resolve_transfers
from lotwise.operators.valuation import chain_value
from lotwise.plans import catalogue

OPEN = "lot_id long, account_id string, invest_date date, trade_date date, shares decimal(18,5)"
ORDER = "order_id long, account_id string, trade_date date, {} , proceeds decimal(18,2), bought_shares decimal(18,5)"


def stored(spark, tmp_path, rows, schema, name):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/raw-{name}")
    return spark.read.parquet(f"{tmp_path}/raw-{name}")


def raw_inputs(*frames):
    return {file.split("/raw-")[1].split("/")[0] for frame in frames for file in frame.inputFiles() if "/raw-" in file}


def open_lots(spark, tmp_path):
    bought = day("2020-01-01")
    held = [(1, "a", bought, bought, dec(5)), (2, "a", bought, bought, dec(3))]
    return stored(spark, tmp_path, held, OPEN, "lots")


def test_allocation_reads_lots_and_orders_once(spark, tmp_path):
    lots = open_lots(spark, tmp_path)
    asked = [(10, "a", day("2020-02-01"), dec(6), dec(60), None)]
    by_shares = stored(spark, tmp_path, asked, ORDER.format("shares decimal(18,5)"), "share-orders")
    sold, refused = fifo_allocate_shares(by_shares, lots)
    assert raw_inputs(sold, refused) == set()
    assert rows(sold, "lot_id", "shares", "proceeds") == [(1, 5.0, 50.0), (2, 1.0, 10.0)]
    by_lots = stored(spark, tmp_path, [(11, "a", day("2020-02-01"), 1, dec(50), None)], ORDER.format("lots int"), "lot-orders")
    sold, refused = fifo_allocate_lots(by_lots, lots)
    assert raw_inputs(sold, refused) == set()
    assert rows(sold, "lot_id", "shares", "proceeds") == [(1, 5.0, 50.0)]


def test_resolving_reads_operations_once(spark, tmp_path):
    lots = open_lots(spark, tmp_path)
    owner, prices = accounts(spark, ("a", "F", "X"), ("b", "F", "X")), quotes(spark, ("F", "2020-02-01", 2))
    schema = "sale_id long, order_id long, lot_id long, trade_date date, shares decimal(18,5), proceeds decimal(18,2)"
    asked = [(1, 10, 1, day("2020-02-01"), dec(2), None), (2, 10, 1, day("2020-02-01"), None, None)]
    sales = resolve_sales(stored(spark, tmp_path, asked, schema, "ops"), lots, owner, prices)
    assert raw_inputs(sales) == set()
    assert rows(sales, "sale_id", "shares", "proceeds") == [(1, 2.0, 4.0), (2, 3.0, 6.0)]
    schema = schema.replace("trade_date", "sell_date") + ", destination string, buy_date date, bought_shares decimal(18,5)"
    moved = [(*asked[0], "b", None, None)]
    sales, bought = resolve_transfers(stored(spark, tmp_path, moved, schema, "moves"), lots, lots, owner, prices)
    assert raw_inputs(sales, bought) <= {"lots"}
    assert rows(bought, "account_id", "initial_shares", "origin_sale_id") == [("b", 2.0, 1)]


def test_newest_months_sample_the_series_once(spark, tmp_path):
    points = [(1, "2020-01-31"), (1, "2020-02-29"), (2, "2020-02-29"), (2, "2020-03-31"), (None, "2020-05-31")]
    series = stored(spark, tmp_path, [(lot, day(date)) for lot, date in points], "terminal_lot long, date date", "series")
    newest = catalogue._newest_months(series, 1)
    assert raw_inputs(newest) == set()
    assert {found["date"] for found in newest.collect()} == {day("2020-03-31")}
    assert rows(axis_ticks(catalogue._newest_months(series, 2)), "tick", "label") == [("2020-03-01", "Mar")]
    assert axis_ticks(catalogue._newest_months(series.filter("terminal_lot IS NULL"), 1)).isEmpty()


def test_chain_value_deals_hops_out_by_price_and_by_chain_one_after_the_other(spark, tmp_path):
    """Lot 2 was switched to another account of its fund on 1 March, lot 4 bought for money of another fund."""
    held = builders.ledger(
        spark,
        accounts=accounts(spark, ("a", "F", "X"), ("b", "F", "Y"), ("g", "G", "X")),
        quotes=quotes(spark, *[(fund, day, nav) for day, nav in (("2020-01-01", 1), ("2020-03-01", 2), ("2020-05-01", 3)) for fund in "FG"]),
        lots=builders.lots(
            spark,
            (1, "a", "2020-01-01", "2020-01-01", 10, 10, None),
            (2, "b", "2020-01-01", "2020-03-01", 10, 20, 1),
            (3, "g", "2020-01-01", "2020-01-01", 6, 6, None),
            (4, "a", "2020-01-01", "2020-03-01", 6, 12, 3),
        ),
        orders=builders.orders(spark, (1, "2020-03-01"), (3, "2020-03-01")),
        sales=builders.sales(spark, (1, 1, 1, 10, 20), (3, 3, 3, 6, 12)),
    )
    lineage(held).write.parquet(f"{tmp_path}/raw-lineage")
    walked = spark.read.parquet(f"{tmp_path}/raw-lineage")
    value = chain_value(walked, held)
    assert raw_inputs(value) == set()
    assert rows(value, "terminal_lot", "account_id", "initial", "capital") == [(2, "b", 10.0, 10.0), (4, "a", 6.0, 12.0)]
    later = chain_value(walked, held, start=day("2020-04-01"))
    assert rows(later, "terminal_lot", "initial", "capital") == [(2, 30.0, 30.0), (4, 18.0, 18.0)]
