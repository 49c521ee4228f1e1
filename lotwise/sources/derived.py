"""A fund ledger derived from order, line and part tables.

The rules follow FIXTURES.md: a line of an order is a lot, the line's flag says
whether the lot is held, redeemed or moved into the next line's lot, and part
prices are the quotes.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.functions.numbers import money, price
from lotwise.operators.running import id_block, row_numbers, running, with_neighbours
from lotwise.schemas import LEDGER, MONEY, NAV, SHARES
from lotwise.session import written
from lotwise.sources.tables import sorted_by, typed

LINE_ORDER = [
    "l_shipdate",
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_returnflag",
    "l_linestatus",
]

# Lot ids hold the order and the line's number; a longer order stops the job.
LINES_PER_ORDER = 10_000_000
ORDER_ROWS = 1 << 20  # lines of an order that one task reads in order
ORDER_HASHES = 1 << 16

_stored: dict[tuple, DerivedLedger] = {}


def _isin(number):
    return F.concat(F.lit("FX"), F.lpad((number % 10).cast("string"), 10, "0"))


def _priced(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Lines with the price of their part; a line keeps its place in the order without one.

    A key that stands for several parts has them all in ``_more``, a column that is only there if some key does.
    """
    prices = part.groupBy(F.col("p_partkey").alias("l_partkey")).agg(
        F.collect_list(F.struct(F.col("p_retailprice").cast(NAV).alias("price"))).alias("_all")
    )
    prices = prices.select(
        "l_partkey", F.col("_all")[0]["price"].alias("retail"), F.when(F.size("_all") > 1, F.col("_all")).alias("_more"), F.lit(True).alias("_part")
    )
    # Written, so that the join sees its true size and can split a part that many lines name.
    prices = written(prices, "prices")
    if prices.filter(F.col("_more").isNotNull()).isEmpty():
        prices = prices.drop("_more")
    # One row per key in any share of the prices, so lines need no sort to meet theirs.
    return lineitem.join(prices.hint("shuffle_hash"), "l_partkey", "left")


def _long_orders(lineitem: DataFrame) -> DataFrame | None:
    """Orders with more lines than one task should read, if any: counted by hash first, then exactly."""
    line = lineitem.select("l_orderkey", F.pmod(F.xxhash64("l_orderkey"), F.lit(ORDER_HASHES)).alias("_hash"))
    full = written(line.groupBy("_hash").count().filter(F.col("count") > ORDER_ROWS).select("_hash"), "full")
    if full.isEmpty():
        return None
    counts = line.join(full, "_hash", "left_semi").groupBy("l_orderkey").count()
    long = written(counts.filter(F.col("count") > ORDER_ROWS).select("l_orderkey"), "long-orders")
    return None if long.isEmpty() else long


def numbered_lines(lineitem: DataFrame, orders: DataFrame, long: bool) -> DataFrame:
    """Priced lines with owner, fund and their number within the order."""
    if long:
        seq = row_numbers(lineitem, ["l_orderkey"], [LINE_ORDER[:2]], LINE_ORDER[2:], "seq")
    else:
        in_order = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
        seq = lineitem.withColumn("seq", F.row_number().over(in_order).cast("long"))
    distributor = F.when(F.col("l_suppkey") % 20 >= 10, "B1").otherwise("B0")
    too_long = F.raise_error("an order has more lines than lot ids have room for").cast("long")
    checked = F.when(F.col("seq") < LINES_PER_ORDER, F.col("seq")).otherwise(too_long)
    found = seq.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).filter("_part")
    if "_more" in found.columns:
        one = F.array(F.struct(F.col("retail").alias("price")))
        found = found.withColumn("_price", F.explode(F.coalesce("_more", one))).withColumn("retail", F.col("_price.price"))
    return found.select(
        "l_orderkey",
        "seq",
        (F.col("l_orderkey") * LINES_PER_ORDER + checked).alias("lot_id"),
        F.concat_ws("-", F.col("o_custkey"), _isin(F.col("l_suppkey")), distributor).alias("account_id"),
        _isin(F.col("l_suppkey")).alias("isin"),
        distributor.alias("distributor"),
        F.to_date("l_shipdate").alias("trade_date"),
        F.col("l_quantity").cast(SHARES).alias("quantity"),
        F.col("l_extendedprice").cast(MONEY).alias("cost"),
        "retail",
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
    )


def chained_lines(lines: DataFrame, long: bool) -> DataFrame:
    """Add the neighbours of each line and the first date of its chain."""
    previous = {"previous_flag": "flag"}
    following = {"next_date": "trade_date", "next_account": "account_id"}
    by_number = Window.partitionBy("l_orderkey").orderBy("seq")
    if long:
        linked = with_neighbours(lines, "l_orderkey", "seq", previous, following)
    else:
        linked = lines.withColumns(
            {
                **{name: F.lag(source).over(by_number) for name, source in previous.items()},
                **{name: F.lead(source).over(by_number) for name, source in following.items()},
            }
        )
    moved_in = F.coalesce(F.col("previous_flag") == "A", F.lit(False))
    # Lines are in date order, so the latest chain start is the greatest one.
    started = linked.withColumns({"_start": F.when(~moved_in, F.col("trade_date")), "moved_in": moved_in})
    if long:
        started = started.withColumn("_block", id_block("seq"))
        chained = running(started, ["l_orderkey"], [["_block"]], ["seq"], {"invest_date": ("max", "_start")})
        return chained.drop("_start", "_block")
    until_now = by_number.rowsBetween(Window.unboundedPreceding, 0)
    return started.withColumn("invest_date", F.max("_start").over(until_now)).drop("_start")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all orders in their chains.

    They are dealt to tasks by part for the price and then once by order, for all that
    depends on the lines of an order. Orders too long for a task are cut into tiers.
    """
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", *LINE_ORDER)
    lineitem = lineitem.filter(F.col("l_orderkey").isNotNull())  # no order has them
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_retailprice")
    long = _long_orders(lineitem)
    priced = _priced(lineitem, part)
    if long is None:
        return chained_lines(numbered_lines(priced, orders, False), False)
    rest = priced.join(long, "l_orderkey", "left_anti")
    tiered = priced.join(long, "l_orderkey", "left_semi")
    lines = chained_lines(numbered_lines(rest, orders, False), False)
    return lines.unionByName(chained_lines(numbered_lines(tiered, orders, True), True))


def _funds(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("n")
    return (
        spark.read.parquet(f"{sf_dir}/supplier.parquet")
        .select((F.col("s_suppkey") % 10).alias("n"))
        .distinct()
        .select(
            _isin(number).alias("isin"),
            F.concat(F.lit("Fund "), number).alias("name"),
            F.when(number % 2 == 0, F.concat(F.lit("F"), number)).alias("alias"),
            F.concat(F.lit("M"), number % 3).alias("manager"),
            F.lit("EUR").alias("currency"),
            (1 + number % 7).cast("int").alias("risk"),
            F.when(number % 3 == 0, "csv").when(number % 3 == 1, "json").alias("feed"),
            (number != 9).alias("active"),
            F.concat(F.lit("K"), number).alias("feed_key"),
        )
    )


class DerivedLedger:
    """The ledger tables of the given folder, computed by Spark; each is derived when it is first read.

    Lots are columns of the written lines. Sales and their orders come out of one exchange and are
    columns of one written table. What a query does not read is not derived for it.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._sf_dir = spark, sf_dir

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in LEDGER}

    @cached_property
    def _lines(self) -> DataFrame:
        lines = order_lines(self._spark, self._sf_dir)
        moves_on = (F.col("flag") == "A") & F.col("next_date").isNotNull()
        return written(
            lines.select(
                "lot_id",
                "account_id",
                "isin",
                "distributor",
                "invest_date",
                "trade_date",
                "quantity",
                "cost",
                "retail",
                "flag",
                "status",
                "moved_in",
                F.when(moves_on, F.col("next_date")).alias("next_date"),
                F.when(moves_on, F.col("next_account")).alias("next_account"),
            ),
            "lines",
        )

    @cached_property
    def _sold(self) -> DataFrame:
        """Sold lines with their order: the sales of one account on one day to one destination."""
        col = F.col
        sold = self._lines.filter(col("flag").isin("A", "R")).select(
            col("lot_id").alias("sale_id"),
            "account_id",
            F.coalesce("next_date", F.date_add("trade_date", 30)).alias("trade_date"),
            F.coalesce("next_account", F.lit("")).alias("destination"),
            F.when(col("status") == "F", col("quantity")).otherwise(col("quantity") / 2).cast(SHARES).alias("shares"),
            money(col("quantity") * col("retail")).alias("proceeds"),
        )
        in_order = Window.partitionBy("account_id", "trade_date", "destination").orderBy("sale_id")
        until_now = in_order.rowsBetween(Window.unboundedPreceding, 0)
        return written(
            sold.select(
                "sale_id",
                F.min("sale_id").over(until_now).alias("order_id"),
                (F.row_number().over(in_order) == 1).alias("first"),
                "trade_date",
                F.when(col("destination") == "", "redemption").otherwise("transfer").alias("comment"),
                "shares",
                "proceeds",
            ),
            "sold",
        )

    @cached_property
    def _feed_keys(self) -> DataFrame:
        return _funds(self._spark, self._sf_dir)

    def _stored(self, name: str, table: DataFrame) -> DataFrame:
        return written(typed(name, table), name)

    @cached_property
    def feeds(self) -> DataFrame:
        return self._stored("feeds", self._feed_keys.filter(F.col("feed").isNotNull()).select("feed").distinct())

    @cached_property
    def funds(self) -> DataFrame:
        return self._stored("funds", self._feed_keys)

    @cached_property
    def fund_feeds(self) -> DataFrame:
        return self._stored("fund_feeds", self._feed_keys.filter(F.col("feed").isNotNull() & F.col("alias").isNotNull()))

    @cached_property
    def accounts(self) -> DataFrame:
        """Sorted by account, so that filters on it skip row groups; made distinct in the exchange that sorts."""
        ranged = self._lines.select("account_id", "isin", "distributor").repartitionByRange("account_id")
        return self._stored("accounts", ranged.distinct().sortWithinPartitions("account_id"))

    @cached_property
    def lots(self) -> DataFrame:
        origin = F.when(F.col("moved_in"), F.col("lot_id") - 1)
        return typed("lots", self._lines.withColumnRenamed("quantity", "initial_shares").withColumn("origin_sale_id", origin))

    @cached_property
    def orders(self) -> DataFrame:
        return typed("orders", self._sold.filter("first"))

    @cached_property
    def sales(self) -> DataFrame:
        """A sale without a date belongs to no order."""
        dated = self._sold.filter(F.col("trade_date").isNotNull())
        return typed("sales", dated.withColumn("lot_id", F.col("sale_id")))

    @cached_property
    def quotes(self) -> DataFrame:
        nav = price(F.max("retail")).alias("nav")
        found = self._lines.groupBy("isin", F.col("trade_date").alias("date")).agg(nav)
        return self._stored("quotes", sorted_by("quotes", found))


def input_stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Sizes and times of the input files, which tell whether a stored result still holds."""
    stamp = [spark.sparkContext.applicationId, sf_dir]
    for name in ("lineitem", "orders", "part", "supplier"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        stamp += [files.getFileStatus(path).getModificationTime(), files.getContentSummary(path).getLength()]
    return tuple(stamp)


def stored_ledger(spark: SparkSession, sf_dir: str) -> DerivedLedger:
    """The derived ledger, whose tables are written once per application and input."""
    key = input_stamp(spark, sf_dir)
    if key not in _stored:
        _stored[key] = DerivedLedger(spark, sf_dir)
    return _stored[key]
