"""Small tables for tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from lotwise.schemas import ACCOUNT, FEED, FUND, FUND_FEED, LOT, QUOTE, SALE, SALE_ORDER
from lotwise.sources.tables import Ledger


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def dec(value) -> Decimal | None:
    return None if value is None else Decimal(str(value))


def funds(spark, *rows):
    """Rows of isin, name, alias, feed, active."""
    full = [(isin, name, alias, None, "EUR", 3, feed, active) for isin, name, alias, feed, active in rows]
    return spark.createDataFrame(full, FUND)


def feeds(spark, *rows):
    return spark.createDataFrame(list(rows), FUND_FEED)


def accounts(spark, *rows):
    return spark.createDataFrame(list(rows), ACCOUNT)


def quotes(spark, *rows):
    return spark.createDataFrame([(isin, day(date), dec(nav)) for isin, date, nav in rows], QUOTE)


def lots(spark, *rows):
    """Rows of lot, account, invest date, trade date, shares, cost, origin."""
    return spark.createDataFrame(
        [(i, a, day(v), day(t), dec(s), dec(c), o) for i, a, v, t, s, c, o in rows], LOT
    )


def orders(spark, *rows):
    return spark.createDataFrame([(i, day(date), None) for i, date in rows], SALE_ORDER)


def sales(spark, *rows):
    return spark.createDataFrame([(i, o, lot, dec(s), dec(p)) for i, o, lot, s, p in rows], SALE)


def ledger(spark, **tables) -> Ledger:
    empty = {
        "feeds": FEED,
        "funds": FUND,
        "fund_feeds": FUND_FEED,
        "accounts": ACCOUNT,
        "lots": LOT,
        "orders": SALE_ORDER,
        "sales": SALE,
        "quotes": QUOTE,
    }
    return Ledger(**{name: tables.get(name) or spark.createDataFrame([], schema) for name, schema in empty.items()})


def rows(df, *columns):
    """Sorted tuples, decimals as floats and dates as text."""
    found = df.select(*columns) if columns else df
    plain = [
        tuple(float(v) if isinstance(v, Decimal) else str(v) if isinstance(v, dt.date) else v for v in row)
        for row in found.collect()
    ]
    return sorted(plain, key=lambda row: tuple((v is None, str(type(v)), v) for v in row if v is not None))
