"""Chains of lots, from a holding or redemption back to the new money."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.functions.numbers import money, ratio, value_of
from lotwise.functions.returns import annualised
from lotwise.operators import chain_fractions
from lotwise.operators.filters import _where, lineage_condition
from lotwise.operators.lots import open_lots, sale_view
from lotwise.operators.quotes import last_quote
from lotwise.schemas import MONEY, NAV, RATIO, SHARES
from lotwise.session import discard, written
from lotwise.sources.tables import Ledger

# Workers get the helper's code with the task, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(chain_fractions)

_HOP = [
    "terminal_lot",
    "order_id",
    "hop",
    "lot_id",
    "account_id",
    "isin",
    "invest_date",
    "trade_date",
    "end_date",
    "fraction",
    "cost",
    "nav",
    "shares",
    "proceeds",
    "origin_sale_id",
]


def _owned(ledger: Ledger) -> DataFrame:
    """Lots with the fund of their account."""
    return ledger.lots.join(ledger.accounts.select("account_id", "isin"), "account_id")


def _held(ledger: Ledger, owned: DataFrame) -> DataFrame:
    """Last hop of the chains that are still held: open lots, as order 0."""
    latest = last_quote(ledger.quotes).withColumnRenamed("date", "end_date")
    fund = owned.select("isin", *ledger.lots.columns)
    left = open_lots(fund, ledger.sales, "isin")
    return (
        left.filter(F.col("shares") > 0)
        .join(latest, "isin", "left")
        .select(
            F.col("lot_id").alias("terminal_lot"),
            F.lit(0).cast("long").alias("order_id"),
            F.lit(0).alias("hop"),
            "lot_id",
            "account_id",
            "isin",
            "invest_date",
            "trade_date",
            "end_date",
            ratio(F.col("shares"), F.col("initial_shares")).alias("fraction"),
            "cost",
            "nav",
            "shares",
            money(value_of(F.col("shares"), F.col("nav"))).alias("proceeds"),
            "origin_sale_id",
        )
    )


def _redeemed(sold: DataFrame) -> DataFrame:
    """Last hop of the chains that ended in a sale."""
    return sold.filter("NOT funded").select(
        F.col("lot_id").alias("terminal_lot"),
        "order_id",
        F.lit(0).alias("hop"),
        "lot_id",
        "account_id",
        "isin",
        "invest_date",
        "trade_date",
        "end_date",
        F.col("part").alias("fraction"),
        money(F.col("cost") * F.col("part")).alias("cost"),
        F.lit(None).cast(NAV).alias("nav"),
        "shares",
        "proceeds",
        "origin_sale_id",
    )


def _sold_lots(ledger: Ledger, owned: DataFrame) -> DataFrame:
    """Sales with the lot they came out of, the part of it they sold and whether they funded a lot."""
    origins = ledger.lots.select(F.col("origin_sale_id").alias("sale_id")).filter(F.col("sale_id").isNotNull()).distinct()
    marked = ledger.sales.join(origins.withColumn("_funded", F.lit(True)), "sale_id", "left")
    return (
        sale_view(marked, ledger.orders, "_funded")
        .withColumnRenamed("trade_date", "end_date")
        .join(owned, "lot_id")
        .select(
            "sale_id",
            "order_id",
            F.col("_funded").isNotNull().alias("funded"),
            "lot_id",
            "account_id",
            "isin",
            "invest_date",
            "trade_date",
            "end_date",
            ratio(F.col("shares"), F.col("initial_shares")).alias("part"),
            "cost",
            "shares",
            "proceeds",
            "origin_sale_id",
        )
    )


def _transfer_edges(sold: DataFrame) -> DataFrame:
    """For each sale that funded a lot: the lot it came out of."""
    return sold.filter("funded").select(
        F.col("sale_id").alias("_sale"),
        "lot_id",
        "account_id",
        "isin",
        "invest_date",
        "trade_date",
        "end_date",
        "part",
        "cost",
        "shares",
        "proceeds",
        "origin_sale_id",
    )


def _jumps(edges: DataFrame) -> Iterator[DataFrame]:
    """From each sale to the one that funded its lot, over 1, 2, 4, … transfers; each is there until the next is.

    A walk that is longer than there are sales goes round in a circle.
    """
    sales = edges.count()
    jump = edges.filter(F.col("origin_sale_id").isNotNull()).select("_sale", F.col("origin_sale_id").alias("_to"))
    reach, jump = 1, written(jump, "jumps")
    while not jump.isEmpty():
        if reach > sales:
            raise ValueError("transfers form a circle")
        yield jump
        following = jump.select(F.col("_sale").alias("_to"), F.col("_to").alias("_next"))
        before, reach = jump, 2 * reach
        jump = written(jump.join(following, "_to").select("_sale", F.col("_next").alias("_to")), "jumps")
        discard(before)
    discard(jump)


def _walk(anchor: DataFrame, edges: DataFrame) -> list[DataFrame]:
    """Chains and the sales they go back to, in parts: the walk doubles its reach each round, which is written once."""
    found = anchor.filter(F.col("origin_sale_id").isNotNull()).select(
        "terminal_lot",
        "order_id",
        F.lit(1).alias("hop"),
        F.col("fraction").alias("_last"),
        F.col("origin_sale_id").alias("_sale"),
    )
    parts = [written(found, "walk")]
    for reach, jump in enumerate(_jumps(edges)):
        further = _together(parts).join(jump, "_sale").select(
            "terminal_lot", "order_id", (F.col("hop") + 2**reach).alias("hop"), "_last", F.col("_to").alias("_sale")
        )
        parts.append(written(further, "walk"))
    return parts


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _with_fractions(hops: DataFrame) -> DataFrame:
    """Add what part of each hop's lot ends up in the terminal lot, rounded from hop to hop."""
    spread = hops.repartition("terminal_lot", "order_id").sortWithinPartitions("terminal_lot", "order_id", "hop")
    schema = T.StructType([*hops.schema.fields, T.StructField("_fraction", RATIO), T.StructField("fraction", RATIO)])
    return spread.mapInArrow(chain_fractions.add_fractions, schema)


def _parents(hops: DataFrame) -> DataFrame:
    fraction = F.col("fraction")
    return hops.select(
        "terminal_lot",
        "order_id",
        "hop",
        "lot_id",
        "account_id",
        "isin",
        "invest_date",
        "trade_date",
        "end_date",
        "fraction",
        money(F.col("cost") * fraction).alias("cost"),
        F.lit(None).cast(NAV).alias("nav"),
        F.round(F.col("shares") * F.col("_fraction"), 4).cast(SHARES).alias("shares"),
        F.round(F.col("proceeds") * F.col("_fraction"), 2).cast(MONEY).alias("proceeds"),
        "origin_sale_id",
    )


def lineage(
    ledger: Ledger,
    order_id: int | None = None,
    terminal_lot: int | None = None,
    redeemed: bool | None = None,
) -> DataFrame:
    """All hops of every chain, with the chain's first lot and its capital.

    The walk up the transfers doubles its reach each round and is written to the
    shared folder, so plans stay short and a lost executor costs one round. The
    predicates are the same for a whole chain and are applied where the walk starts.
    """
    condition = lineage_condition(order_id, terminal_lot, redeemed)
    # Written once: lots are looked up for holdings and again for sales, sales for the ends of chains and for the walk.
    owned = written(_owned(ledger), "owned")
    sold = written(_sold_lots(ledger, owned), "sold")
    anchor = _where(_held(ledger, owned), *condition).unionByName(_where(_redeemed(sold), *condition))
    untouched = F.col("origin_sale_id").isNull()
    anchor = written(anchor.select(*_HOP), "lineage")
    discard(owned)
    single = anchor.filter(untouched).select(
        *_HOP, F.col("lot_id").alias("origin_lot"), F.col("cost").alias("capital")
    )
    chains = anchor.filter(~untouched)
    made_of = [anchor, sold]
    if chains.isEmpty():
        result = single
    else:
        edges = _transfer_edges(sold)
        walk = _walk(anchor, edges)
        older = _parents(_with_fractions(_together(walk).join(edges, "_sale").drop("_sale")))
        result = single.unionByName(_with_chain_start(chains.unionByName(older)))
        made_of += walk
    result._made_of = made_of
    return result


def _with_chain_start(chains: DataFrame) -> DataFrame:
    """Chains of two or more hops with the lot and cost they began with."""
    oldest_first = Window.partitionBy("terminal_lot", "order_id").orderBy(
        "trade_date", F.desc("hop")
    )
    return chains.select(
        *_HOP,
        F.first("lot_id").over(oldest_first).alias("origin_lot"),
        F.first("cost").over(oldest_first).alias("capital"),
    )


def enriched_lineage(lineage: DataFrame, accounts: DataFrame, funds: DataFrame) -> DataFrame:
    """Lineage with the distributor of each hop and the alias of its fund."""
    alias = funds.select("isin", F.coalesce("alias", "name").alias("alias"))
    return (
        lineage.join(accounts.select("account_id", "distributor"), "account_id")
        .join(alias, "isin")
        .select(
            "terminal_lot",
            "order_id",
            "lot_id",
            "account_id",
            "distributor",
            "isin",
            "alias",
            "invest_date",
            "trade_date",
            "end_date",
            "shares",
            "proceeds",
        )
    )


def fiscal_gains(lineage: DataFrame) -> DataFrame:
    """Gain of every redemption and holding against its original capital."""
    return lineage.filter(F.col("terminal_lot") == F.col("lot_id")).select(
        "terminal_lot",
        "order_id",
        "account_id",
        "isin",
        "origin_lot",
        "invest_date",
        "end_date",
        "capital",
        "shares",
        "proceeds",
        (F.col("proceeds") - F.col("capital")).cast(MONEY).alias("gain"),
    )


def gain_lines(
    gains: DataFrame, accounts: DataFrame, funds: DataFrame, redeemed: bool | None = None
) -> DataFrame:
    """Gains with names, days held and percentages."""
    gains = _where(gains, *lineage_condition(redeemed=redeemed))
    alias = funds.select("isin", F.coalesce("alias", "name").alias("alias"))
    gain, capital = F.col("gain"), F.col("capital")
    days = F.datediff("end_date", "invest_date")
    return (
        gains.join(accounts.select("account_id", "distributor"), "account_id")
        .join(alias, "isin")
        .withColumns(
            {
                "days": days,
                "gain_percent": F.try_divide(gain.cast("double"), capital.cast("double")) * 100,
                "annual_percent": annualised(gain, capital, days),
            }
        )
    )
