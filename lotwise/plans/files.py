"""Writes ledger tables as the text and feed files that the sources read.

Every text file also gets comment and blank lines, which readers must skip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.session import new_path, shuffles_dropped


def append_lines(lines: DataFrame, folder: str) -> str:
    """Add the lines as gzipped files, one a task, which text readers open by their name."""
    with shuffles_dropped(lines.sparkSession):
        lines.select("value").write.mode("append").text(folder, compression="gzip")
    return folder


def _file(lines: DataFrame) -> str:
    spark = lines.sparkSession
    noise = spark.range(1).select(F.explode(F.array(F.lit("# comment | line"), F.lit(""), F.lit("   "))).alias("value"))
    return append_lines(lines.unionByName(noise), new_path(spark, "text"))


def _line(*cells: Column | str) -> Column:
    texts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cells]
    return F.concat_ws(" | ", *texts).alias("value")


def quote_lines(quotes: DataFrame) -> DataFrame:
    return quotes.select(_line("isin", "date", "nav"))


def quote_file(quotes: DataFrame) -> str:
    return _file(quote_lines(quotes))


def fund_file(funds: DataFrame, fund_feeds: DataFrame) -> str:
    """Active funds leave the currency to its default; keys are the last cell."""
    currency = F.when(~F.col("active"), "USD")
    active = F.when(F.col("active"), "yes").otherwise("no")
    return _file(
        funds.join(fund_feeds, ["feed", "isin"], "left").select(
            _line("isin", "name", "alias", "manager", "feed", "risk", active, currency, "feed_key")
        )
    )


def account_file(accounts: DataFrame) -> str:
    return _file(accounts.select(_line("account_id", "isin", "distributor")))


def subscription_file(ops: DataFrame) -> str:
    """Purchases without shares leave the last cell out."""
    full, short = _line("account_id", "trade_date", "cost", "shares"), _line("account_id", "trade_date", "cost")
    return _file(ops.select(F.when(F.col("shares").isNull(), short).otherwise(full).alias("value")))


def _quantity(shares: str) -> Column:
    return F.when(F.col("order_id") % 2 == 0, F.col("lots").cast("string")).otherwise(F.col(shares).cast("string"))


def redemption_file(account_sales: DataFrame) -> str:
    return _file(account_sales.select(_line("account_id", "trade_date", _quantity("shares"), "proceeds", "comment")))


def transfer_file(account_transfers: DataFrame) -> str:
    return _file(
        account_transfers.filter(F.col("destination").isNotNull()).select(
            _line("source", "sell_date", "destination", "buy_date", _quantity("sold_shares"), "proceeds", "bought_shares", "comment")
        )
    )


def quote_range_file(quotes: DataFrame) -> str:
    """First and last quote of each fund and year, and one reversed range each."""
    spans = quotes.groupBy("isin", F.year("date").alias("year")).agg(
        F.min("date").alias("first"), F.max("date").alias("last")
    )
    good, bad = _line("isin", "first", "last"), _line("isin", F.date_add("last", 1), "first")
    return _file(spans.select(F.explode(F.array(good, bad)).alias("value")))


def bad_subscription_file(lots: DataFrame) -> str:
    """Each lot as a good line and as a short, misdated or overlong one."""
    turn = F.col("lot_id") % 3
    broken = (
        F.when(turn == 0, F.col("account_id"))
        .when(turn == 1, F.concat("account_id", F.lit("|1999-02-30|5.00")))
        .otherwise(F.concat("account_id", F.lit("|1999-02-03|5.00|1|x")))
    )
    good = _line("account_id", "trade_date", "cost", "initial_shares")
    return _file(lots.select(F.explode(F.array(good, broken)).alias("value")))


def _by_fund(quotes: DataFrame, row: Column) -> DataFrame:
    """The quotes of each fund as one array, newest last; bounded by the calendar."""
    return quotes.groupBy("isin").agg(F.sort_array(F.collect_list(row)).alias("rows"))


def csv_feed(quotes: DataFrame) -> str:
    """One response a fund, with one, three or six digits of a second and two lines that are no quotes."""
    folder = new_path(quotes.sparkSession, "csv")
    zeros = F.element_at(F.array(F.lit("0"), F.lit("000"), F.lit("000000")), F.dayofmonth("date") % 3 + 1)
    row = F.concat(
        F.date_format("date", "yyyy-MM-dd"), F.lit(" 00:00:00."), zeros, F.lit(";"),
        F.regexp_replace(F.col("nav").cast("string"), r"\.", ","),
    )
    text = F.concat_ws("\n", F.lit("Date;Value"), F.lit("1999-02-30 00:00:00.0;1,0"), F.lit("1999-02-03 00:00:00.0;-"), F.array_join("rows", "\n"))
    _by_fund(quotes, row).select("isin", text.alias("value")).write.partitionBy("isin").text(folder)
    return folder


def json_feed(quotes: DataFrame) -> str:
    """One response a fund with a row without a price, and one short response a fund."""
    folder = new_path(quotes.sparkSession, "json")
    seconds = F.unix_timestamp(F.col("date").cast("timestamp"))
    row = F.struct(seconds.alias("rowDateRaw"), F.col("nav").cast("double").alias("last_closeRaw"))
    rows = F.concat("rows", F.array(F.struct(F.lit(0).cast("long").alias("rowDateRaw"), F.lit(None).cast("double").alias("last_closeRaw"))))
    data = F.struct(F.struct(F.struct(F.struct(rows.alias("data")).alias("vars")).alias("body")).alias("nested"))
    blank = F.lit(None).cast("struct<nested: struct<body: struct<vars: struct<data: array<struct<rowDateRaw: bigint, last_closeRaw: double>>>>>>")

    def response(*blocks):
        return F.struct(F.struct(F.array(*blocks).alias("_list")).alias("content")).alias("body")

    funds = _by_fund(quotes, row)
    funds.select("isin", response(blank, data, blank)).write.partitionBy("isin").json(folder)
    funds.select("isin", response(blank)).write.mode("append").partitionBy("isin").json(folder)
    return folder
