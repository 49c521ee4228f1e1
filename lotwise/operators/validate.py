"""Rule violations of a ledger, one row each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.schemas import LEDGER, SHARES
from lotwise.sources.tables import Ledger


def _broken(table: DataFrame, name: str, key: Column, condition: Column, reason: str) -> DataFrame:
    return table.filter(condition).select(
        F.lit(name).alias("table_name"), key.cast("string").alias("key"), F.lit(reason).alias("reason")
    )


# Columns that identify a row, the first entry of each table being its key.
KEYS = {
    "feeds": [["feed"]],
    "funds": [["isin"]],
    "fund_feeds": [["feed", "isin"]],
    "accounts": [["account_id"]],
    "lots": [["lot_id"], ["origin_sale_id", "account_id", "trade_date"]],
    "orders": [["order_id"]],
    "sales": [["sale_id"], ["order_id", "lot_id"]],
    "quotes": [["isin", "date"]],
}
REFERENCES = {
    "feeds": {},
    "funds": {"feed": "feeds"},
    "fund_feeds": {"feed": "feeds", "isin": "funds"},
    "accounts": {"isin": "funds"},
    "lots": {"account_id": "accounts", "origin_sale_id": "sales"},
    "orders": {},
    "sales": {"lot_id": "lots", "order_id": "orders"},
    "quotes": {"isin": "funds"},
}


# Tables whose columns are checked for missing values.
RULED = ["funds", "accounts", "lots", "orders", "sales", "quotes"]


def _key(columns: list[str]) -> Column:
    return F.concat_ws("/", *columns) if len(columns) > 1 else F.col(columns[0]).cast("string")


def _known(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def _broken_rules(name: str, table: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule that a row breaks; the many rows that break none are set apart before."""
    reasons = F.array(*[F.when(rule, F.lit(reason)) for reason, rule in rules.items()])
    broken = table.filter(reduce(lambda a, b: a | b, rules.values()))
    reason = F.explode(F.array_compact(reasons)).alias("reason")
    return broken.select(F.lit(name).alias("table_name"), _key(KEYS[name][0]).alias("key"), reason)


def _repeated(name: str, table: DataFrame, columns: list[str]) -> DataFrame:
    counts = table.filter(_known(columns)).groupBy(*columns).agg(F.count("*").alias("_rows"))
    return _broken(counts, name, _key(columns), F.col("_rows") > 1, f"repeated {'/'.join(columns)}")


def _unknown(name: str, table: DataFrame, column: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows that refer to a key no row of ``parents`` has.

    Both sides are plain rows under their own types, so that a value many rows refer to can be split.
    """
    known = F.col(column).isNotNull()
    child = table.filter(known).select(_key(KEYS[name][0]).alias("key"), F.col(column).alias("_value"))
    dangling = child.join(parents.select(F.col(parent_key).alias("_value")), "_value", "left_anti")
    return _broken(dangling, name, F.col("key"), F.lit(True), f"unknown {column}")


def _sold_too_far(lots: DataFrame, sales: DataFrame) -> DataFrame:
    """Lots that sales name although their shares are unknown or fewer than those sold."""
    sold = (
        sales.filter(F.col("lot_id").isNotNull())
        .groupBy("lot_id")
        .agg(F.sum(F.col("shares").cast(SHARES)).alias("_sold"))
    )
    held = F.col("initial_shares").cast(SHARES)
    reason = F.when(held.isNull(), "sold with unknown shares").when(F.col("_sold") > held, "too many shares sold")
    return (
        lots.select("lot_id", "initial_shares")
        .join(sold, "lot_id")
        .select(F.lit("lots").alias("table_name"), F.col("lot_id").cast("string").alias("key"), reason.alias("reason"))
        .filter("reason IS NOT NULL")
    )


def _missing(name: str, keys: list[str]) -> dict[str, Column]:
    """Rules for the columns of a table that must have a value, apart from its key."""
    required = [f.name for f in LEDGER[name].fields if not f.nullable and f.name not in keys]
    return {f"missing {column}": F.col(column).isNull() for column in required}


def validate_ledger(ledger: Ledger) -> DataFrame:
    """Missing values, broken value rules, repeated keys, dangling references and excess sales.

    Rules of single rows need no exchange. Keys and references are dealt out by their own
    values, each with nothing but the key of its row.
    """
    lots, sales, orders = ledger.lots, ledger.sales, ledger.orders
    shares, proceeds = F.col("shares"), F.col("proceeds")
    tables = {name: getattr(ledger, name) for name in KEYS}
    rules = {name: _missing(name, KEYS[name][0]) if name in RULED else {} for name in KEYS}
    rules["lots"] |= {
        "shares not positive": F.col("initial_shares") <= 0,
        "neither shares nor cost": F.col("initial_shares").isNull() & F.col("cost").isNull(),
    }
    rules["sales"] |= {
        "shares not positive": shares <= 0,
        "proceeds negative": proceeds < 0,
        "neither shares nor proceeds": shares.isNull() & proceeds.isNull(),
    }
    found = [_broken_rules(name, table, rules[name]) for name, table in tables.items() if rules[name]]
    found += [_repeated(name, tables[name], columns) for name, keys in KEYS.items() for columns in keys]
    found += [
        _unknown(name, tables[name], column, tables[parent], KEYS[parent][0][0])
        for name, parents in REFERENCES.items()
        for column, parent in parents.items()
    ]
    found.append(_sold_too_far(lots, sales))
    sold_after = (
        lots.filter(F.col("origin_sale_id").isNotNull())
        .select("lot_id", "trade_date", F.col("origin_sale_id").alias("sale_id"))
        .join(sales.select("sale_id", "order_id"), "sale_id")
        .join(orders.select("order_id", F.col("trade_date").alias("sell_date")), "order_id")
    )
    early = _broken(sold_after, "lots", F.col("lot_id"), F.col("trade_date") < F.col("sell_date"), "bought before sold")
    return reduce(DataFrame.unionByName, [*found, early])


def validate_orders(orders: DataFrame) -> DataFrame:
    """Account orders that name both a number of lots and of shares."""
    both = F.col("lots").isNotNull() & F.col("shares").isNotNull()
    return _broken(orders, "orders", F.col("order_id"), both, "both lots and shares")
