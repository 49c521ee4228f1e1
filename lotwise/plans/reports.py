"""Reports: detail lines with their totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.returns import tax_rate
from lotwise.operators.filters import filter_portfolio
from lotwise.operators.lineage import gain_lines
from lotwise.operators.quotes import fund_trend
from lotwise.schemas import TOTAL_MONEY
from lotwise.session import written
from lotwise.sources.tables import Ledger


def _percent(part, whole):
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100


def report_with_totals(portfolio: DataFrame) -> DataFrame:
    """Portfolio lines followed by one TOTAL line, in a single pass."""
    keys = [F.col("isin"), F.col("distributor")]
    return (
        portfolio.groupingSets([keys, []], *keys)
        .agg(
            F.grouping_id("isin", "distributor").alias("_level"),
            F.sum("capital").cast(TOTAL_MONEY).alias("capital"),
            F.sum("valuation").cast(TOTAL_MONEY).alias("valuation"),
        )
        .select(
            F.when(F.col("_level") == 0, F.col("isin")).otherwise("TOTAL").alias("line"),
            "distributor",
            "capital",
            "valuation",
            F.round(_percent(F.col("valuation") - F.col("capital"), F.col("capital")), 2).alias("gain_percent"),
        )
        .orderBy(F.col("line") == "TOTAL", "line", "distributor")
    )


def totals_by_currency(portfolio: DataFrame, funds: DataFrame) -> DataFrame:
    """Positions, capital, value and gain of each currency; amounts of different currencies are not added."""
    currency = funds.select("isin", "currency")
    return (
        portfolio.join(currency, "isin")
        .groupBy("currency")
        .agg(
            F.count("*").alias("positions"),
            F.sum("capital").cast(TOTAL_MONEY).alias("capital"),
            F.sum("valuation").cast(TOTAL_MONEY).alias("valuation"),
        )
        .withColumn("gain_percent", F.round(_percent(F.col("valuation") - F.col("capital"), F.col("capital")), 2))
    )


def portfolio_report(positions: DataFrame, ledger: Ledger) -> DataFrame:
    """Live positions with fund names, risk, gain and trend, and a TOTAL line."""
    names = ledger.funds.select("isin", F.coalesce("alias", "name").alias("alias"), "risk")
    lines = (
        filter_portfolio(positions, alive=True)
        .join(names, "isin")
        .join(fund_trend(ledger.funds, ledger.quotes), "isin")
        .select(
            "alias",
            "isin",
            "risk",
            "account_id",
            "distributor",
            "prior_gain",
            "capital",
            "shares",
            (F.col("weight") * 100).alias("weight_percent"),
            "date",
            "nav",
            "rising",
            (F.col("valuation") - F.col("capital")).alias("gain"),
            (F.col("gain") * 100).alias("gain_percent"),
        )
    )
    # Detail and total read the same written lines.
    lines = written(lines, "report")
    sums = {name: F.sum(name).alias(name) for name in ("prior_gain", "capital", "gain")}
    total = lines.agg(*sums.values()).select(
        F.lit("TOTAL").alias("alias"),
        *sums,
        F.lit(100.0).alias("weight_percent"),
        F.round(_percent(F.col("gain"), F.col("capital")), 2).alias("gain_percent"),
    )
    return lines.unionByName(total, allowMissingColumns=True).orderBy(
        F.col("alias") == "TOTAL", F.coalesce("risk", F.lit(0)), "account_id"
    )


def yearly_totals(lines: DataFrame) -> DataFrame:
    """Capital, proceeds, gain and gain percent per year of the sale or quote."""
    return (
        lines.filter(F.col("end_date").isNotNull())
        .groupBy(F.year("end_date").alias("year"))
        .agg(
            F.sum("capital").cast(TOTAL_MONEY).alias("capital"),
            F.sum("proceeds").cast(TOTAL_MONEY).alias("proceeds"),
            F.sum("gain").cast(TOTAL_MONEY).alias("gain"),
        )
        .withColumn("gain_percent", _percent(F.col("gain"), F.col("capital")))
    )


def gain_report(
    gains: DataFrame, ledger: Ledger, redeemed: bool | None = None
) -> DataFrame:
    """Gain lines by account and investment date, followed by yearly totals."""
    lines = written(gain_lines(gains, ledger.accounts, ledger.funds, redeemed), "report")
    totals = yearly_totals(lines).withColumn("line", F.lit("TOTAL"))
    detail = lines.withColumn("line", F.concat_ws("/", "terminal_lot", "order_id"))
    columns = [
        "line",
        "year",
        "alias",
        "distributor",
        "account_id",
        "capital",
        "invest_date",
        "end_date",
        "shares",
        "proceeds",
        "gain",
        "gain_percent",
        "annual_percent",
    ]
    return (
        detail.unionByName(totals, allowMissingColumns=True)
        .select(*columns)
        .orderBy(F.col("line") == "TOTAL", "year", "account_id", "invest_date", "line")
    )


def tax_due(gains: DataFrame) -> DataFrame:
    """Tax on each year's redeemed gains, at the rate of the bracket they fall in.

    A year that ends in a loss owes nothing.
    """
    yearly = (
        gains.filter((F.col("order_id") != 0) & F.col("gain").isNotNull())
        .groupBy(F.year("end_date").alias("year"))
        .agg(F.sum("gain").cast(TOTAL_MONEY).alias("gain"))
    )
    rate = tax_rate(F.col("gain"))
    taxed = F.greatest(F.col("gain"), F.lit(0).cast(TOTAL_MONEY))
    return yearly.select(
        "year", "gain", rate.alias("rate"), F.round(taxed * rate, 2).cast(TOTAL_MONEY).alias("tax")
    )
