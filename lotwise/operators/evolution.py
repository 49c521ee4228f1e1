"""Value of every chain sampled by weeks or months."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.dates import bucket_end, bucket_number, last_bucket
from lotwise.functions.numbers import exact_product, units, value_of
from lotwise.functions.returns import series_label
from lotwise.operators.quotes import nearest_quotes
from lotwise.schemas import NAV, SHARES, VALUE
from lotwise.session import written

BLOCK_BITS = 6  # sampling buckets of a fund are met 64 at a time

COLUMNS = [
    "period",
    "terminal_lot",
    "order_id",
    "lot_id",
    "cost",
    "trade_date",
    "end_date",
    "shares",
    "isin",
    "date",
    "value",
]


def sample_range(
    lots: DataFrame, start: dt.date | None, end: dt.date | None, as_of: dt.date
) -> tuple[dt.date, dt.date]:
    """Asked range, cut to the first purchase and to ``as_of``."""
    first = lots.agg(F.min("trade_date")).first()[0]
    begin = start if start is not None and start >= first else first
    return begin, end if end is not None and end <= as_of else as_of


def sampled_quotes(
    quotes: DataFrame, begin: dt.date, finish: dt.date, period: str
) -> DataFrame:
    """Last quote per fund in each right-closed bucket."""
    last = last_bucket(begin, finish, period)
    number = bucket_number(F.col("date"), F.lit(begin), period)
    low = bucket_end(F.lit(begin), F.lit(-1), period)
    high = bucket_end(F.lit(begin), F.lit(last), period)
    return (
        quotes.filter((F.col("date") > low) & (F.col("date") <= high))
        .groupBy("isin", number.alias("bucket"))
        .agg(F.max("date").alias("date"), F.max_by("nav", "date").alias("nav"))
    )


def evolution(
    lineage: DataFrame,
    lots: DataFrame,
    quotes: DataFrame,
    period: str,
    as_of: dt.date,
    start: dt.date | None = None,
    end: dt.date | None = None,
    shown: bool = False,
) -> DataFrame:
    """Sampled value of each chain, its starting value, and the axis dates.

    A hop meets the sampled quotes of its fund as arrays of up to ``2**BLOCK_BITS``
    buckets and is exploded afterwards, so that rows of the result are never dealt out
    again. The starting value is found per chain before.

    With ``shown``, days are text and amounts doubles: those of a hop or a sampled quote
    are converted once, not again for each of the many rows that have them.
    """

    def day(column: Column) -> Column:
        return column.cast("string") if shown else column

    def amount(column: Column) -> Column:
        return column.cast("double") if shown else column

    begin, finish = sample_range(lots, start, end, as_of)
    last = last_bucket(begin, finish, period)
    samples = written(sampled_quotes(quotes, begin, finish, period), "samples")
    hops = lineage.filter(F.col("end_date").isNotNull()).select(
        "terminal_lot", "order_id", "lot_id", "isin", "invest_date", "trade_date", "end_date", "shares", "cost"
    )
    opened = nearest_quotes(
        hops.select("isin", F.col("trade_date").alias("date")), samples, True
    ).select(
        "isin",
        F.col("date").alias("trade_date"),
        F.col("quote_date").alias("sample_date"),
        F.col("nav").alias("sample_nav"),
    )
    new_money = (F.col("invest_date") == F.col("trade_date")) & (F.col("trade_date") >= F.lit(begin))
    sampled = F.col("sample_date") <= F.col("end_date")
    # The purchase itself is a point, unless its day was sampled.
    bought = new_money & ~F.coalesce(F.col("sample_date") == F.col("trade_date"), F.lit(False))
    first_value = F.when(bought, F.col("cost").cast(VALUE)).when(
        sampled, value_of(F.col("shares"), F.col("sample_nav")).cast(VALUE)
    )
    first_date = F.when(bought, F.col("trade_date")).when(sampled, F.col("sample_date"))
    chain = Window.partitionBy("terminal_lot", "order_id")
    earliest = F.when(F.col("first_date").isNotNull(), F.struct("first_date", "trade_date", "lot_id"))
    hops = (
        hops.join(opened, ["isin", "trade_date"], "left")
        .withColumns({"bought": bought, "first_date": first_date, "first_value": first_value})
        .withColumn("start_value", F.min_by("first_value", earliest).over(chain))
        .drop("sample_date", "sample_nav", "first_date", "first_value")
    )
    since = F.greatest(bucket_number(F.col("trade_date"), F.lit(begin), period), F.lit(0))
    until = F.least(bucket_number(F.col("end_date"), F.lit(begin), period), F.lit(last))
    first_block, last_block = (F.shiftright(bucket, BLOCK_BITS) for bucket in (since, until))
    blocks = F.when(since <= until, F.sequence(first_block, last_block))
    sample = F.struct("date", "nav", units(F.col("nav"), NAV).alias("units"), F.lit(False).alias("paid"), day(F.col("date")).alias("shown"))
    pieces = samples.groupBy("isin", F.shiftright("bucket", BLOCK_BITS).alias("block")).agg(
        F.collect_list(sample).alias("points")
    )
    # Written, so that the join can split the hops of a fund.
    pieces = written(pieces, "pieces")
    bought_on = F.col("trade_date")
    unpriced = F.lit(None).cast(NAV).alias("nav"), F.lit(None).cast("double").alias("units")
    paid = F.array(F.struct(bought_on.alias("date"), *unpriced, F.lit(True).alias("paid"), day(bought_on).alias("shown")))
    none = F.array().cast(pieces.schema["points"].dataType)
    is_first = F.col("block").isNull() | (F.col("block") == first_block)
    held = (F.col("point.date") >= F.col("trade_date")) & (F.col("point.date") <= F.col("end_date"))
    points = (
        hops.withColumn("block", F.explode_outer(blocks))
        .join(pieces, ["isin", "block"], "left")
        .withColumns(
            {
                "series_cost": amount(F.col("start_value")),
                "series_begin": day(F.col("trade_date")),
                "series_end": day(F.col("end_date")),
                "series_shares": amount(F.col("shares")),
                "paid_value": amount(F.col("cost").cast(VALUE)),
                "share_units": units(F.col("shares"), SHARES),
            }
        )
        .withColumn(
            "point", F.explode(F.when(F.col("bought") & is_first, F.concat(paid, F.coalesce("points", none))).otherwise(F.col("points")))
        )
        .filter(F.col("point.paid") | held)
    )
    worth = amount(value_of(F.col("shares"), F.col("point.nav")).cast(VALUE))
    if shown:
        worth = exact_product(F.col("share_units"), F.col("point.units"), SHARES.scale + NAV.scale, worth)
    series = points.select(
        F.lit(period).alias("period"),
        "terminal_lot",
        "order_id",
        "lot_id",
        F.col("series_cost").alias("cost"),
        F.col("series_begin").alias("trade_date"),
        F.col("series_end").alias("end_date"),
        F.col("series_shares").alias("shares"),
        "isin",
        F.col("point.shown").alias("date"),
        F.when(F.col("point.paid"), F.col("paid_value")).otherwise(worth).alias("value"),
    )
    axis = (
        lots.sparkSession.range(last + 1)
        .select(
            F.lit(period).alias("period"),
            day(bucket_end(F.lit(begin), F.col("id"), period)).alias("date"),
        )
    )
    return series.unionByName(axis, allowMissingColumns=True).select(*COLUMNS)


def return_series(evolution: DataFrame) -> DataFrame:
    """Return since the start of each series, per sampled date."""
    value, cost = F.col("value").cast("double"), F.col("cost").cast("double")
    return evolution.filter(F.col("terminal_lot").isNotNull()).select(
        series_label(F.col("terminal_lot"), F.col("order_id")).alias("series"),
        "date",
        (F.try_divide(value, cost) - 1).alias("return"),
    )


def axis_ticks(evolution: DataFrame) -> DataFrame:
    """Tick per month for ranges of up to two calendar years, else per year."""
    low, high = F.col("low"), F.col("high")
    span = evolution.filter(F.col("terminal_lot").isNotNull()).agg(
        F.min("date").alias("low"), F.max("date").alias("high")
    )
    monthly = F.year(high) - F.year(low) <= 2
    first_month = F.add_months(F.trunc(low, "month"), 1)
    first_year = F.add_months(F.trunc(low, "year"), 12)
    months = F.sequence(first_month, high, F.expr("interval 1 month"))
    years = F.sequence(first_year, high, F.expr("interval 1 year"))
    tick = F.col("tick")
    return (
        span.select(
            monthly.alias("monthly"),
            F.explode(
                F.when(monthly & (first_month <= high), months).when(
                    ~monthly & (first_year <= high), years
                )
            ).alias("tick"),
        )
        .select(
            "tick",
            F.when(~F.col("monthly") | (F.month(tick) == 1), F.date_format(tick, "yyyy"))
            .otherwise(F.date_format(tick, "MMM"))
            .alias("label"),
        )
    )
