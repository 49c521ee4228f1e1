"""Views over lots, sales and transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.numbers import money, ratio, value_of
from lotwise.schemas import SHARES


def fund_view(funds: DataFrame, fund_feeds: DataFrame) -> DataFrame:
    """Funds with their feed key; alias falls back to name, key to isin."""
    return funds.join(fund_feeds, ["feed", "isin"], "left").select(
        "isin",
        "name",
        F.coalesce("alias", "name").alias("alias"),
        "manager",
        "currency",
        "risk",
        "feed",
        F.coalesce("feed_key", "isin").alias("feed_key"),
        "active",
    )


def sold_by_lot(sales: DataFrame) -> DataFrame:
    """Shares sold out of each lot."""
    return sales.groupBy("lot_id").agg(F.sum("shares").cast(SHARES).alias("sold"))


def open_lots(lots: DataFrame, sales: DataFrame, *also: str) -> DataFrame:
    """What is left of every lot: shares and the cost of those shares, and ``also`` other columns."""
    sold = F.coalesce(F.col("sold"), F.lit(0).cast(SHARES))
    left = (F.col("initial_shares") - sold).cast(SHARES)
    return lots.join(sold_by_lot(sales), "lot_id", "left").select(
        "lot_id",
        "account_id",
        "invest_date",
        "trade_date",
        "initial_shares",
        left.alias("shares"),
        money(F.col("cost") * (1 - ratio(sold, F.col("initial_shares")))).alias("cost"),
        "origin_sale_id",
        *also,
    )


def sale_view(sales: DataFrame, orders: DataFrame, *also: str) -> DataFrame:
    """Sales with the date and comment of their order, and ``also`` other columns."""
    return sales.join(orders, "order_id").select(
        "sale_id", "order_id", "lot_id", "trade_date", "shares", "proceeds", "comment", *also
    )


def transfer_view(sales: DataFrame, orders: DataFrame, lots: DataFrame) -> DataFrame:
    """Sales with the lot they funded; plain sales have no destination."""
    children = lots.filter(F.col("origin_sale_id").isNotNull()).select(
        F.col("origin_sale_id").alias("sale_id"),
        F.col("account_id").alias("destination"),
        F.col("trade_date").alias("buy_date"),
        F.col("initial_shares").alias("bought_shares"),
    )
    return (
        sale_view(sales, orders)
        .join(children, "sale_id", "left")
        .select(
            "sale_id",
            "order_id",
            "lot_id",
            F.col("trade_date").alias("sell_date"),
            F.col("shares").alias("sold_shares"),
            "proceeds",
            "destination",
            "buy_date",
            "bought_shares",
            "comment",
        )
    )


def account_sales(sales: DataFrame, orders: DataFrame, lots: DataFrame) -> DataFrame:
    """Sales grouped by order and account, with the number of lots sold."""
    return (
        sales.join(lots.select("lot_id", "account_id"), "lot_id")
        .groupBy("order_id", "account_id")
        .agg(
            F.count("*").alias("lots"),
            F.sum("shares").alias("shares"),
            F.sum("proceeds").alias("proceeds"),
        )
        .join(orders, "order_id")
        .select("order_id", "account_id", "trade_date", "lots", "shares", "proceeds", "comment")
    )


def account_transfers(sales: DataFrame, orders: DataFrame, lots: DataFrame) -> DataFrame:
    """Transfers grouped by order, accounts and purchase date."""
    return (
        transfer_view(sales, orders, lots)
        .join(lots.select("lot_id", F.col("account_id").alias("source")), "lot_id")
        .groupBy("order_id", "source", "sell_date", "destination", "buy_date", "comment")
        .agg(
            F.count("*").alias("lots"),
            F.sum("sold_shares").alias("sold_shares"),
            F.sum("proceeds").alias("proceeds"),
            F.sum("bought_shares").alias("bought_shares"),
        )
    )


def distributor_switches(lots: DataFrame, sales: DataFrame, accounts: DataFrame) -> DataFrame:
    """Lots bought by moving the same fund to another account.

    The funds of both accounts are compared, never the lots they hold.
    """
    fund_of = accounts.select("account_id", "isin")
    children = (
        lots.filter(F.col("origin_sale_id").isNotNull())
        .join(fund_of, "account_id")
        .select(
            F.col("origin_sale_id").alias("sale_id"),
            F.col("lot_id").alias("switched_lot"),
            F.col("trade_date").alias("buy_date"),
            F.col("isin").alias("bought_isin"),
        )
    )
    return (
        children.join(sales.select("sale_id", "lot_id"), "sale_id")
        .join(lots.select("lot_id", "account_id"), "lot_id")
        .join(fund_of, "account_id")
        .filter(F.col("isin") == F.col("bought_isin"))
        .select(F.col("switched_lot").alias("lot_id"), "buy_date", "isin")
    )


def commission(
    lots: DataFrame, sales: DataFrame, accounts: DataFrame, quotes: DataFrame
) -> DataFrame:
    """Part of a lot's cost that its price does not explain."""
    priced = quotes.select("isin", F.col("date").alias("trade_date"), "nav")
    paid = F.coalesce("cost", money(value_of(F.col("shares"), F.col("nav"))))
    return (
        open_lots(lots, sales)
        .join(accounts.select("account_id", "isin"), "account_id")
        .join(priced, ["isin", "trade_date"], "left")
        .select(
            "lot_id",
            "isin",
            "trade_date",
            "shares",
            "nav",
            paid.alias("cost"),
            (paid - value_of(F.col("shares"), F.col("nav"))).alias("commission"),
            (F.col("shares") > 0).alias("active"),
        )
    )
