"""First-in-first-out allocation of account orders to lots.

Orders depend on those before them in their account only, so accounts are dealt to
tasks in one exchange, and each is read in order. An account too large for that is
served by lines, which many tasks share: its lots and orders are laid out on one line each: a lot covers the
shares from the end of the lot before it, an order those from the end of the
order before it. An order takes from the lots it overlaps. Both lines are cut
at all their starting points, and each piece looks back for the lot and order
it lies in, so the work is lots + orders, never lots x orders.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.numbers import money, ratio, trunc5
from lotwise.operators import account_state
from lotwise.operators.running import id_block, running
from lotwise.schemas import SHARES, TOTAL_SHARES
from lotwise.session import written

# Workers get the helper's code with the task, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(account_state)

_TIERS = 16
ACCOUNT_ROWS = 1 << 20  # lots and orders of an account that one task reads in order


def _length(column: str):
    return F.col(column).cast(TOTAL_SHARES)


def lot_line(lots: DataFrame) -> DataFrame:
    """Lots with the stretch [lo, hi) they cover; oldest investment first.

    ``lots`` has account_id, lot_id, invest_date, trade_date, size.
    """
    blocked = lots.withColumn("_block", id_block("lot_id"))
    line = running(
        blocked,
        ["account_id"],
        [["invest_date"], ["_block"]],
        ["lot_id"],
        {"hi": ("sum", "size")},
    )
    return line.select(
        "account_id", "lot_id", (F.col("hi") - F.col("size")).cast(TOTAL_SHARES).alias("lo"), _length("hi").alias("hi")
    )


def _with_visible(orders: DataFrame, lots: DataFrame) -> DataFrame:
    """Add how much the account's lots bought up to the order's date amount to."""
    until = (
        Window.partitionBy("account_id")
        .orderBy("trade_date")
        .rangeBetween(Window.unboundedPreceding, 0)
    )
    visible = F.coalesce(F.sum("size").over(until), F.lit(0)).cast(TOTAL_SHARES).alias("visible")
    supply = lots.select("account_id", "trade_date", "size")
    # A large account is reduced to its days first, so the window is bounded.
    days = supply.groupBy("account_id", "trade_date").agg(F.sum("size").alias("size"))
    asked = orders.select("account_id", "trade_date").distinct().withColumn("asked", F.lit(True))
    found = (
        days.unionByName(asked, allowMissingColumns=True)
        .select("account_id", "trade_date", "asked", visible)
        .filter("asked")
        .drop("asked")
    )
    return orders.join(found, ["account_id", "trade_date"])


def order_line(orders: DataFrame) -> DataFrame:
    """Orders with the stretch [lo, hi) they ask for, in date and id order.

    ``orders`` has account_id, order_id, trade_date, amount, visible; a NULL
    amount asks for everything visible and resets the line to that point.
    """
    tiers, order = [["trade_date"], ["_block"]], ["order_id"]
    blocked = orders.withColumns(
        {"_block": id_block("order_id"), "_amount": F.coalesce("amount", F.lit(0)).cast(TOTAL_SHARES)}
    )
    summed = running(blocked, ["account_id"], tiers, order, {"_total": ("sum", "_amount")})
    everything = F.struct("trade_date", "order_id", "visible", _length("_total").alias("total"))
    reset = running(
        summed.withColumn("_reset", F.when(F.col("amount").isNull(), everything)),
        ["account_id"],
        tiers,
        order,
        {"_last": ("max", "_reset")},
        inclusive=False,
    )
    base = F.coalesce(F.col("_last.visible") - F.col("_last.total"), F.lit(0))
    lo = base + F.col("_total") - F.col("_amount")
    return reset.select(
        *orders.columns,
        lo.cast(TOTAL_SHARES).alias("lo"),
        F.when(F.col("amount").isNull(), F.greatest(lo, F.col("visible")))
        .otherwise(lo + F.col("_amount"))
        .cast(TOTAL_SHARES)
        .alias("hi"),
    )


def settle_orders(orders: DataFrame, lots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orders that can be served, as a line, and those that ask for too much.

    A refused order asks nothing of the lots, so the orders after it move up.
    Each round settles the accounts without excess. Of the others it fixes all
    orders before the first excess, and refuses that order with all later ones
    that cannot fit whatever happens between.
    """
    position = F.struct("trade_date", "order_id")
    open_orders = _with_visible(orders, lots)
    settled, refusals = [], []
    while True:
        line = written(order_line(open_orders), "orders")
        settled.append(line)
        excess = (F.col("hi") > F.col("visible")) | (F.col("hi") <= F.col("lo"))
        first = written(
            line.filter(excess)
            .groupBy("account_id")
            .agg(F.min(position).alias("_first"), F.min_by("lo", position).alias("_fixed")),
            "excess",
        )
        unsettled = line.join(first, "account_id")
        refused = unsettled.filter(
            (position == F.col("_first"))
            | ((position > F.col("_first")) & (F.col("_fixed") + F.col("amount") > F.col("visible")))
        ).select("order_id", "account_id")
        refusals.append(refused)
        if first.isEmpty():
            break
        settled[-1] = line.join(first.select("account_id"), "account_id", "left_anti")
        open_orders = unsettled.select(*line.columns).drop("lo", "hi").join(
            refused.select("order_id"), "order_id", "left_anti"
        )
    return reduce(DataFrame.unionByName, settled), reduce(DataFrame.unionByName, refusals)


def overlaps(order_stretches: DataFrame, lot_stretches: DataFrame) -> DataFrame:
    """Pieces of the line that lie in both an order and a lot.

    Starting points are sorted in tiers of the position's high bits, so one
    account's line is swept by many tasks.
    """
    unit = F.col("lo") * 100000
    lot = F.struct("lo", "hi", "lot_id")
    order = F.struct("lo", "hi", "order_id")
    starts = lot_stretches.select(
        "account_id", unit.cast("long").alias("at"), lot.alias("lot"), F.lit(None).alias("order")
    ).unionByName(
        order_stretches.select(
            "account_id", unit.cast("long").alias("at"), F.lit(None).alias("lot"), order.alias("order")
        )
    )
    points = starts.groupBy("account_id", "at").agg(F.max("lot").alias("lot"), F.max("order").alias("order"))
    points = points.withColumns(
        {"_far": F.shiftright("at", 2 * _TIERS), "_near": F.shiftright("at", _TIERS)}
    )
    swept = running(
        points,
        ["account_id"],
        [["_far"], ["_near"]],
        ["at"],
        {"in_lot": ("max", "lot"), "in_order": ("max", "order")},
    )
    at = (F.col("at") / F.lit(100000).cast("decimal(6,0)")).cast(TOTAL_SHARES)
    end = F.least("in_lot.hi", "in_order.hi")
    both = F.col("in_lot").isNotNull() & F.col("in_order").isNotNull()
    return swept.filter(both & (end > at)).select(
        "account_id", "in_order.order_id", "in_lot.lot_id", (end - at).cast(SHARES).alias("taken")
    )


SERVED = "account_id string, order_id long, lot_id long, taken long"


def _in_order(orders: DataFrame, lots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Serve the orders of accounts one after the other, from one exchange by account.

    Rows arrive sorted and are read as a stream, which refuses on the way; it holds
    the live lots of one account.
    """

    def units(column: str):
        return (F.col(column) * 100000).cast("long").alias("size")

    supply = lots.select(
        "account_id", "trade_date", F.lit(account_state.LOT).alias("kind"),
        F.unix_date("invest_date").alias("invested"), F.col("lot_id").alias("own_id"), units("size"),
    )
    asked = orders.select(
        "account_id", "trade_date", F.lit(account_state.ORDER).alias("kind"),
        F.lit(None).cast("int").alias("invested"), F.col("order_id").alias("own_id"), units("amount"),
    )
    # Lots of accounts that nobody orders from are left out.
    supply = supply.join(orders.select("account_id").distinct(), "account_id", "left_semi")
    rows = supply.unionByName(asked).repartition("account_id")
    rows = rows.sortWithinPartitions("account_id", "trade_date", "kind", "own_id")
    names = ["account_id", "kind", "invested", "own_id", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = account_state.Allocation()
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            made = list(zip(*state.serve(zip(*(batch.column(n).to_pylist() for n in names))))) or [[]] * 4
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(made, kinds)], ["account_id", "order_id", "lot_id", "taken"]
            )

    served = written(rows.select(*names).mapInArrow(run, SERVED), "served")
    taken = (F.col("taken").cast("decimal(18,0)") / F.lit(100000).cast("decimal(6,0)")).cast(SHARES)
    pieces = served.filter("lot_id IS NOT NULL").select("account_id", "order_id", "lot_id", taken.alias("taken"))
    return pieces, served.filter("lot_id IS NULL").select("order_id", "account_id")


def allocate(orders: DataFrame, lots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Serve orders from lots; results are pieces of lots and refused orders.

    ``orders`` has account_id, order_id, trade_date, amount; ``lots`` has
    account_id, lot_id, invest_date, trade_date, size. Accounts of up to
    ``ACCOUNT_ROWS`` rows are served in order, many in a task. A larger account is cut
    over many tasks (``_by_lines``); the rows are the same. Both tables are read several
    times, so callers write them.
    """
    rows = lots.select("account_id").unionByName(orders.select("account_id")).groupBy("account_id").count()
    large = written(rows.filter(F.col("count") > ACCOUNT_ROWS).select("account_id"), "large-accounts")
    if large.isEmpty():
        return _in_order(orders, lots)

    def apart(how: str) -> tuple[DataFrame, DataFrame]:
        return orders.join(large, "account_id", how), lots.join(large, "account_id", how)

    both = zip(_in_order(*apart("left_anti")), _by_lines(*apart("left_semi")))
    pieces, refusals = (one.unionByName(other) for one, other in both)
    return pieces, refusals


def _by_lines(orders: DataFrame, lots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``allocate`` by lines of lots and orders, for accounts of any size.

    A lot that arrives by transfer may be an older investment than lots already
    there and so enters the line at its front. Orders are served up to the account's
    next such arrival, for all accounts at once; the rest wait for the next round.
    There are at most as many rounds as days on which an account gets such lots.
    """
    older = F.col("invest_date") < F.col("trade_date")
    lots = written(lots, "lots")
    pieces = refusals = None
    while True:
        first = orders.groupBy("account_id").agg(F.min("trade_date").alias("_first"))
        arrival = (
            lots.filter(older)
            .join(first, "account_id")
            .filter(F.col("trade_date") > F.col("_first"))
            .groupBy("account_id")
            .agg(F.min("trade_date").alias("_arrival"))
        )
        waits = F.coalesce(F.col("trade_date") >= F.col("_arrival"), F.lit(False))
        split = written(orders.join(arrival, "account_id", "left").withColumn("_waits", waits), "split")
        reachable = lots.join(arrival, "account_id", "left").filter(~(older & waits)).drop("_arrival")
        line, refused = settle_orders(
            split.filter(~F.col("_waits")).select("account_id", "order_id", "trade_date", "amount"),
            reachable,
        )
        taken = written(overlaps(line, lot_line(reachable)), "taken")
        pieces = taken if pieces is None else pieces.unionByName(taken)
        refusals = refused if refusals is None else refusals.unionByName(refused)
        orders = split.filter("_waits").select("account_id", "order_id", "trade_date", "amount")
        if orders.isEmpty():
            return pieces, refusals
        used = taken.groupBy("lot_id").agg(F.sum("taken").alias("_used"))
        left = (F.col("size") - F.coalesce("_used", F.lit(0))).cast(TOTAL_SHARES)
        lots = written(
            lots.join(used, "lot_id", "left").withColumn("size", left).drop("_used").filter("size > 0"), "left"
        )


def _shared(pieces: DataFrame, orders: DataFrame) -> DataFrame:
    """Split each order's money and bought shares pro rata to the shares sold."""
    totals = pieces.groupBy("order_id").agg(F.sum("shares").cast(TOTAL_SHARES).alias("_total"))
    part = ratio(F.col("shares"), F.col("_total"))
    terms = orders.select("order_id", "trade_date", "proceeds", "bought_shares")
    return pieces.join(totals.join(terms, "order_id"), "order_id").select(
        "order_id",
        "account_id",
        "lot_id",
        "trade_date",
        "shares",
        money(F.col("proceeds") * part).alias("proceeds"),
        trunc5(F.col("bought_shares") * part).alias("bought_shares"),
    )


def _asked(orders: DataFrame, amount: str) -> DataFrame:
    """Orders as a table: what they ask for, and the terms that are shared afterwards."""
    return written(
        orders.select("account_id", "order_id", "trade_date", amount, "proceeds", "bought_shares"), "orders"
    )


def fifo_allocate_shares(orders: DataFrame, open_lots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spread orders for a number of shares over an account's lots.

    ``orders`` has order_id, account_id, trade_date, shares, proceeds,
    bought_shares; NULL shares mean everything. Lots bought after the order's
    date are out of reach. Results: sales per lot, and refused orders.
    """
    lots = open_lots.filter(F.col("shares") > 0).select(
        "account_id", "lot_id", "invest_date", "trade_date", _length("shares").alias("size")
    )
    lots, orders = written(lots, "lots"), _asked(orders, "shares")
    pieces, refused = allocate(
        orders.select("account_id", "order_id", "trade_date", _length("shares").alias("amount")), lots
    )
    return _shared(pieces.withColumnRenamed("taken", "shares"), orders), refused.withColumn(
        "reason", F.lit("too many shares")
    )


def fifo_allocate_lots(orders: DataFrame, open_lots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sell the oldest live lots of an account, as many as the order names.

    ``orders`` has order_id, account_id, trade_date, lots, proceeds,
    bought_shares. Results: sales per lot, and refused orders.
    """
    live = open_lots.filter(F.col("shares") > 0)
    live = written(live.select("account_id", "lot_id", "invest_date", "trade_date", "shares"), "lots")
    orders = _asked(orders, "lots")
    lots = live.select(
        "account_id", "lot_id", "invest_date", "trade_date", F.lit(1).cast(TOTAL_SHARES).alias("size")
    )
    pieces, refused = allocate(
        orders.select("account_id", "order_id", "trade_date", _length("lots").alias("amount")), lots
    )
    sold = pieces.drop("taken").join(live.select("lot_id", "shares"), "lot_id")
    return _shared(sold, orders), refused.withColumn("reason", F.lit("too many lots"))
