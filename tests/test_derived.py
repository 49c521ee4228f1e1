"""The ledger derived from order lines, and the exchanges it takes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lotwise.plans.catalogue import QUERIES
from lotwise.sources import derived

LINE = (
    "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp"
)


@pytest.fixture
def folder(spark, tmp_path):
    """Orders of up to twelve lines, with lines without order, part or date and a part key used twice."""
    draw = random.Random(3)
    lines = [
        (draw.choice([1, 2, 2, 2, 3, 4, None]), draw.choice([1, 2, 3, 9, None]), draw.randrange(40), n % 5, float(draw.randrange(1, 50)),
         float(draw.randrange(100, 900)), draw.choice("ANR"), draw.choice("FO"),
         draw.choice([None, *[dt.datetime(1998, 1, 1 + day) for day in range(9)]]))
        for n in range(60)
    ]
    spark.createDataFrame(lines, LINE).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    parts = [(1, 10.0), (2, 20.0), (3, 30.0), (3, None), (None, 5.0)]
    spark.createDataFrame(parts, "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_long_orders_are_cut_into_tiers_with_the_same_lines(spark, folder, monkeypatch):
    key = ["lot_id", "trade_date", "account_id", "isin", "quantity", "flag", "moved_in", "invest_date"]
    whole = derived.order_lines(spark, folder).select(*key).distinct()
    expected = {row["lot_id"] for row in whole.collect()}
    monkeypatch.setattr(derived, "ORDER_ROWS", 5)
    monkeypatch.setattr(derived, "ORDER_HASHES", 4)
    assert derived._long_orders(spark.read.parquet(f"{folder}/lineitem.parquet").filter("l_orderkey IS NOT NULL")) is not None
    tiered = derived.order_lines(spark, folder).select(*key).distinct()
    assert expected and {row["lot_id"] for row in tiered.collect()} == expected
    single = "lot_id NOT IN (SELECT lot_id FROM twice)"
    whole.groupBy("lot_id").count().filter("count > 1").createOrReplaceTempView("twice")
    assert whole.filter(single).exceptAll(tiered).isEmpty()


def test_lines_are_dealt_by_order_once(spark, folder):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = derived.order_lines(spark, folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1
    assert plan.count("Exchange") == 4


@pytest.fixture
def sold(spark, folder, tmp_path_factory):
    """Two owners who sell and move lots on the same days, one of them without a date, and a line that comes twice."""
    path = str(tmp_path_factory.mktemp("sold"))
    day = dt.datetime(1998, 1, 1)
    kinds = [(flag, day + dt.timedelta(gap)) for gap in (0, 0, 1, 30) for flag in "ARN"] + [("R", None), ("A", None), ("R", None)]
    lines = [(order, 1 + n % 3, n % 2, n, 4.0, 100.0, flag, "FO"[n % 2], date) for order in (1, 2, 3) for n, (flag, date) in enumerate(kinds)]
    spark.createDataFrame([*lines, lines[1]], LINE).write.parquet(f"{path}/lineitem.parquet")
    for name in ("orders", "part"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    spark.createDataFrame([(0,), (1,)], "s_suppkey long").write.parquet(f"{path}/supplier.parquet")
    return path


def test_a_query_derives_only_the_tables_that_it_reads(spark, sold):
    found = QUERIES["account_sales"].run(spark, sold)
    ledger = derived.stored_ledger(spark, sold)
    assert not {"accounts", "quotes", "funds", "feeds", "fund_feeds"} & set(vars(ledger))
    assert ledger.sales.inputFiles() == ledger.orders.inputFiles()
    assert {name.rsplit("/", 2)[1].split("-")[0] for name in found.inputFiles()} == {"lines", "sold"}


def test_sales_and_orders_of_one_exchange_are_those_of_the_groups(spark, sold):
    ledger = derived.DerivedLedger(spark, sold)
    move = "flag = 'A' AND next_date IS NOT NULL"
    lines = ledger._lines.filter("flag IN ('A', 'R')").selectExpr(
        "lot_id",
        "account_id",
        f"CASE WHEN {move} THEN next_date ELSE date_add(trade_date, 30) END AS day",
        f"CASE WHEN {move} THEN next_account ELSE '' END AS destination",
    )
    groups = lines.groupBy("account_id", "day", "destination").agg(F.min("lot_id").alias("order_id"))
    assert groups.filter("day IS NULL").count() and groups.filter("destination <> ''").count()
    orders = groups.selectExpr("order_id", "day", "CASE WHEN destination = '' THEN 'redemption' ELSE 'transfer' END")
    assert sorted(map(tuple, ledger.orders.collect()), key=str) == sorted(map(tuple, orders.collect()), key=str)
    sales = lines.join(groups, ["account_id", "day", "destination"]).select("lot_id", "order_id", "lot_id")
    assert ledger.sales.count() < lines.count()
    found = ledger.sales.select("sale_id", "order_id", "lot_id").collect()
    assert len(found) > 10 and sorted(map(tuple, found)) == sorted(map(tuple, sales.collect()))


def test_accounts_are_distinct_after_one_exchange(spark, sold):
    ledger = derived.DerivedLedger(spark, sold)
    expected = ledger._lines.select("account_id", "isin", "distributor").distinct().collect()
    assert sorted(map(tuple, ledger.accounts.collect())) == sorted(map(tuple, expected))
