"""Optional predicates of the query interface; ``None`` means any value."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _where(df: DataFrame, *conditions: Column | None) -> DataFrame:
    given = [condition for condition in conditions if condition is not None]
    return df.filter(reduce(lambda a, b: a & b, given)) if given else df


def _equals(column: str, value) -> Column | None:
    return None if value is None else F.col(column) == F.lit(value)


def _holding(alive: bool | None) -> Column | None:
    """Held positions have shares, or shares still unknown; closed ones have 0."""
    if alive is None:
        return None
    shares = F.col("shares")
    return shares.isNull() | (shares > 0) if alive else shares == 0


def filter_funds(funds: DataFrame, isin: str | None = None, active: bool | None = None) -> DataFrame:
    return _where(funds, _equals("isin", isin), _equals("active", active))


def filter_accounts(accounts: DataFrame, account_id: str | None = None) -> DataFrame:
    return _where(accounts, _equals("account_id", account_id))


def filter_quotes(
    quotes: DataFrame,
    isin: str | None = None,
    start: dt.date | None = None,
    end: dt.date | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Quotes of a closed date range, newest first, at most ``limit`` of them."""
    if start is not None and start == end:
        dates = [F.col("date") == F.lit(start)]
    else:
        dates = [
            None if start is None else F.col("date") >= F.lit(start),
            None if end is None else F.col("date") <= F.lit(end),
        ]
    found = _where(quotes, _equals("isin", isin), *dates).orderBy(F.desc("date"), "isin")
    return found.limit(limit) if limit else found


def filter_lots(
    open_lots: DataFrame,
    lot_id: int | None = None,
    account_id: str | None = None,
    alive: bool | None = True,
    new_money: bool | None = None,
) -> DataFrame:
    """Lots by account, holding state and origin of the money; an id overrides all."""
    if lot_id is not None:
        return _where(open_lots, _equals("lot_id", lot_id))
    origin = F.col("origin_sale_id")
    funded = {None: None, True: origin.isNull(), False: origin.isNotNull()}[new_money]
    return _where(open_lots, _equals("account_id", account_id), _holding(alive), funded)


def filter_sales(
    account_sales: DataFrame,
    sales: DataFrame,
    lots: DataFrame,
    order_id: int | None = None,
    account_id: str | None = None,
    redeemed: bool | None = None,
) -> DataFrame:
    """Account sales; ``redeemed`` keeps those whose money was not reinvested."""
    if order_id is not None:
        return _where(account_sales, _equals("order_id", order_id))
    found = _where(account_sales, _equals("account_id", account_id))
    if redeemed is None:
        return found
    origins = lots.filter(F.col("origin_sale_id").isNotNull()).select(
        F.col("origin_sale_id").alias("sale_id")
    )
    reinvested = sales.join(origins, "sale_id", "left_semi").select("order_id").distinct()
    return found.join(reinvested, "order_id", "left_anti" if redeemed else "left_semi")


def filter_transfers(
    account_transfers: DataFrame,
    order_id: int | None = None,
    source: str | None = None,
    destination: str | None = None,
) -> DataFrame:
    if order_id is not None:
        return _where(account_transfers, _equals("order_id", order_id))
    return _where(
        account_transfers, _equals("source", source), _equals("destination", destination)
    )


def filter_portfolio(
    portfolio: DataFrame,
    isin: str | None = None,
    distributor: str | None = None,
    alive: bool | None = None,
) -> DataFrame:
    return _where(
        portfolio, _equals("isin", isin), _equals("distributor", distributor), _holding(alive)
    )


def lineage_condition(
    order_id: int | None = None, terminal_lot: int | None = None, redeemed: bool | None = None
) -> list[Column | None]:
    """Predicates that hold for a whole chain or for none of its rows."""
    sold = {None: None, True: F.col("order_id") != 0, False: F.col("order_id") == 0}[redeemed]
    return [_equals("order_id", order_id), _equals("terminal_lot", terminal_lot), sold]


def filter_lineage(
    lineage: DataFrame,
    order_id: int | None = None,
    terminal_lot: int | None = None,
    terminal_only: bool = False,
    redeemed: bool | None = None,
) -> DataFrame:
    terminal = F.col("terminal_lot") == F.col("lot_id") if terminal_only else None
    return _where(lineage, *lineage_condition(order_id, terminal_lot, redeemed), terminal)


def filter_gains(
    gains: DataFrame,
    origin_lot: int | None = None,
    order_id: int | None = None,
    account_id: str | None = None,
) -> DataFrame:
    """Gains by order and account; the original lot overrides both."""
    if origin_lot is not None:
        return _where(gains, _equals("origin_lot", origin_lot))
    return _where(gains, _equals("order_id", order_id), _equals("account_id", account_id))


def filter_variations(variations: DataFrame, last: int) -> DataFrame:
    return variations.filter(F.col("number") <= last)


def filter_evolution(
    evolution: DataFrame, axis: bool = True, terminal_lot: int | bool | None = None
) -> DataFrame:
    """Series rows, axis rows or both; ``terminal_lot=False`` leaves the axis only."""
    lot = F.col("terminal_lot")
    if terminal_lot is None:
        return evolution if axis else evolution.filter(lot.isNotNull())
    if terminal_lot is False:
        return evolution.filter(lot.isNull()) if axis else evolution.limit(0)
    chosen = lot == F.lit(terminal_lot)
    return evolution.filter(lot.isNull() | chosen if axis else chosen)
