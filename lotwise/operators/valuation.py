"""Portfolio value, now and between two dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.numbers import growth, value_of
from lotwise.operators.lots import distributor_switches, open_lots
from lotwise.operators.quotes import last_quote, nearest_quotes
from lotwise.schemas import TOTAL_MONEY, TOTAL_SHARES, VALUE
from lotwise.session import written
from lotwise.sources.tables import Ledger

SALTS = 32  # parts that the hops of one fund and day are cut into

PORTFOLIO = [
    "isin",
    "distributor",
    "capital",
    "shares",
    "weight",
    "date",
    "nav",
    "valuation",
    "gain",
]


def _valued(positions: DataFrame) -> DataFrame:
    """Add valuation, gain and the weight in the whole of all positions.

    The positions are written first: they are few next to the lots behind them,
    and the total would otherwise compute them a second time.
    """
    positions = written(positions, "positions")
    worth = value_of(F.col("shares"), F.col("nav"))
    total = positions.agg(F.sum(worth).cast("double")).scalar()
    return positions.withColumns(
        {
            "weight": F.round(F.try_divide(worth.cast("double"), total), 4),
            "valuation": F.round(worth, 2).cast(TOTAL_MONEY),
            "gain": growth(worth, F.col("capital")),
        }
    )


def portfolio(ledger: Ledger) -> DataFrame:
    """Capital, shares and current value per fund and distributor.

    Lots are summed per account before the account's fund is looked up, so a
    fund that owns most lots costs no more than any other.
    """
    by_account = (
        open_lots(ledger.lots, ledger.sales)
        .groupBy("account_id")
        .agg(F.sum("cost").alias("capital"), F.sum("shares").alias("shares"))
    )
    positions = (
        by_account.join(ledger.accounts, "account_id")
        .groupBy("isin", "distributor")
        .agg(
            F.sum("capital").cast(TOTAL_MONEY).alias("capital"),
            F.sum("shares").cast(TOTAL_SHARES).alias("shares"),
        )
        .join(last_quote(ledger.quotes), "isin", "left")
    )
    return _valued(positions).select(*PORTFOLIO)


def chain_value(
    lineage: DataFrame,
    ledger: Ledger,
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """Value of each held chain at ``start`` and the capital of its last purchase.

    Of every hop only the first and last quote inside the holding and the asked
    range matter; they are looked up as of a date, not by joining all quotes.
    Distributor switches within the range look through to the earlier purchase.
    """
    begin = F.lit(start).cast("date")
    trade_date = F.col("trade_date")
    hops = (
        lineage.filter((F.col("order_id") == 0) & F.col("end_date").isNotNull())
        .withColumns(
            {
                "lo": F.greatest(trade_date, begin),
                "hi": F.least(F.col("end_date"), F.lit(end).cast("date")),
            }
        )
        .filter(F.col("lo") <= F.col("hi"))
        .select("terminal_lot", "lot_id", "account_id", "isin", "trade_date", "shares", "cost", "lo", "hi")
    )
    first = nearest_quotes(hops.select("isin", F.col("lo").alias("date")), ledger.quotes, True)
    last = nearest_quotes(hops.select("isin", F.col("hi").alias("date")), ledger.quotes, False)
    switched = distributor_switches(ledger.lots, ledger.sales, ledger.accounts)
    if start is not None:
        switched = switched.filter(F.col("buy_date") >= begin)
    # Few hops are of switched lots. They are found by narrow rows and go to the rest of their chain.
    marked = hops.select("terminal_lot", "lot_id").join(switched, "lot_id", "left_semi")
    marks = written(marked.groupBy("terminal_lot").agg(F.collect_set("lot_id").alias("switches")), "switches")

    # All live hops of a fund ask for the price of one day, and many for that of ``start``:
    # hops are spread over salts, and each of the few prices is there for every salt.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    progress = (
        hops.withColumn("_salt", F.pmod(F.xxhash64("terminal_lot", "lot_id"), F.lit(SALTS)).cast("int"))
        .join(
            first.select("isin", F.col("date").alias("lo"), F.col("quote_date").alias("first_date"), F.col("nav").alias("first_nav"), salts),
            ["isin", "lo", "_salt"],
        )
        .filter(F.col("first_date") <= F.col("hi"))
        .join(
            last.select("isin", F.col("date").alias("hi"), F.col("quote_date").alias("last_date"), F.col("nav").alias("last_nav"), salts),
            ["isin", "hi", "_salt"],
        )
        .select(
            "terminal_lot", "lot_id", "account_id", "trade_date", "shares", "cost", "first_date", "first_nav", "last_date", "last_nav"
        )
    )
    # Written, so that hops lie on disk only as dealt out by price or by chain, never both.
    progress = written(progress, "progress")
    earliest = F.struct("first_date", "trade_date", "lot_id")
    latest = F.struct("last_date", "trade_date", "lot_id")
    is_switch = F.coalesce(F.array_contains("switches", F.col("lot_id")), F.lit(False))
    chains = (
        progress.join(marks, "terminal_lot", "left")
        .groupBy("terminal_lot")
        .agg(
            F.min_by(F.struct("shares", "first_nav", "trade_date", "cost"), earliest).alias("opening"),
            F.max_by(F.struct("account_id", "last_date", "last_nav", "shares"), latest).alias("current"),
            F.max_by(F.struct("trade_date", "cost"), F.when(~is_switch, latest)).alias("bought"),
        )
    )
    at_start = value_of(F.col("opening.shares"), F.col("opening.first_nav")).cast(VALUE)

    def based(purchase: str):
        held_before = F.col(f"{purchase}.trade_date") < begin
        return F.when(held_before, at_start).otherwise(F.col(f"{purchase}.cost").cast(VALUE))

    return chains.filter(F.col("bought").isNotNull()).select(
        "terminal_lot",
        "current.account_id",
        F.col("current.last_date").alias("date"),
        F.col("current.last_nav").alias("nav"),
        "current.shares",
        based("opening").alias("initial"),
        based("bought").alias("capital"),
    )


def portfolio_between(
    lineage: DataFrame,
    ledger: Ledger,
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """Held positions per account, with capital re-based to their value at ``start``."""
    chains = chain_value(lineage, ledger, start, end)
    by_account = chains.groupBy("account_id").agg(
        F.sum("initial").alias("initial"),
        F.sum("capital").alias("capital"),
        F.max("date").alias("date"),
        F.max_by("nav", "date").alias("nav"),
        F.sum("shares").cast(TOTAL_SHARES).alias("shares"),
    )
    positions = by_account.join(ledger.accounts, "account_id").withColumn(
        "prior_gain", F.round(F.col("capital") - F.col("initial"), 2).cast(TOTAL_MONEY)
    )
    return _valued(positions).select("account_id", "prior_gain", *PORTFOLIO)
