"""Quote look-ups, variations and freshness.

Quotes are unique per fund and day, so the rows of one fund are bounded by the
calendar. Windows over a fund's quotes are therefore small; anything larger
(lots, hops) is reduced to distinct (fund, day) pairs before it meets a window.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.dates import expected_quote_date
from lotwise.functions.numbers import growth, price
from lotwise.functions.returns import percent_change, trend_sign
from lotwise.session import written


def last_quote(quotes: DataFrame, limit: dt.date | None = None) -> DataFrame:
    """Newest quote of each fund, on or before ``limit`` if given."""
    if limit is not None:
        quotes = quotes.filter(F.col("date") <= F.lit(limit))
    return quotes.groupBy("isin").agg(
        F.max("date").alias("date"), F.max_by("nav", "date").alias("nav")
    )


def nearest_quotes(probes: DataFrame, quotes: DataFrame, forward: bool) -> DataFrame:
    """As-of look-up for (isin, date) probes.

    Gives the first quote on or after the date, or the last one on or before.
    Probes are made distinct first: equal pairs share one answer.
    """
    found = F.struct(F.col("date").alias("quote_date"), "nav")
    marks = probes.select("isin", "date").distinct().select(
        "isin", "date", F.lit(None).cast("decimal(12,4)").alias("nav"), F.lit(True).alias("probe")
    ).unionByName(quotes.select("isin", "date", "nav", F.lit(False).alias("probe")))
    direction = F.desc("date") if forward else F.asc("date")
    window = Window.partitionBy("isin").orderBy(direction).rangeBetween(Window.unboundedPreceding, 0)
    known = F.when(~F.col("probe"), found)
    nearest = (F.min if forward else F.max)(known).over(window)
    return (
        marks.withColumn("_found", nearest)
        .filter(F.col("probe") & F.col("_found").isNotNull())
        .select("isin", "date", "_found.quote_date", "_found.nav")
    )


def live_funds(open_lots: DataFrame, accounts: DataFrame, pending: bool = False) -> DataFrame:
    """Funds with shares left, and with lots of unknown shares if ``pending``."""
    live = F.col("shares") > 0
    if pending:
        live = live | F.col("shares").isNull()
    held = open_lots.filter(live).select("account_id").distinct()
    return accounts.join(held, "account_id", "left_semi").select("isin").distinct()


def quote_variation(
    open_lots: DataFrame, accounts: DataFrame, quotes: DataFrame, last: int | None = None
) -> DataFrame:
    """Percent change of each quote to the one before, for funds still held.

    ``number`` counts back from the newest change. With ``last`` only that many
    changes per fund are kept, which lets Spark prune quotes before sorting.
    """
    newest_first = Window.partitionBy("isin").orderBy(F.desc("date"))
    ranked = quotes.join(live_funds(open_lots, accounts), "isin", "left_semi").withColumn(
        "number", F.row_number().over(newest_first)
    )
    if last is not None:
        ranked = ranked.filter(F.col("number") <= last + 1)
    result = (
        ranked.withColumn("previous", F.lead("nav").over(newest_first))
        .filter(F.col("previous").isNotNull())
        .select(
            "isin",
            "date",
            "nav",
            (growth(F.col("nav"), F.col("previous")) * 100).alias("variation"),
            "number",
        )
    )
    return result if last is None else result.filter(F.col("number") <= last)


def quote_history(quotes: DataFrame, isin: str | None = None, days: int = 10) -> DataFrame:
    """Last ``days`` quotes per fund with their change.

    When a fund has no older quote, its first one is compared with itself.
    """
    if isin is not None:
        quotes = quotes.filter(F.col("isin") == F.lit(isin))
    newest_first = Window.partitionBy("isin").orderBy(F.desc("date"))
    previous = F.coalesce(F.lead("nav").over(newest_first), F.col("nav"))
    return (
        quotes.withColumn("number", F.row_number().over(newest_first))
        .filter(F.col("number") <= days + 1)
        .withColumn("previous", previous)
        .filter(F.col("number") <= days)
        .select(
            "isin",
            "date",
            "nav",
            percent_change(F.col("nav"), F.col("previous")).alias("change_percent"),
            trend_sign(F.col("nav"), F.col("previous")).alias("sign"),
        )
    )


def fund_trend(funds: DataFrame, quotes: DataFrame) -> DataFrame:
    """Whether the last quote is above the one before; NULL with fewer than two."""
    newest_first = Window.partitionBy("isin").orderBy(F.desc("date"))
    latest = (
        quotes.withColumn("number", F.row_number().over(newest_first))
        .filter(F.col("number") <= 2)
        .groupBy("isin")
        .agg(
            F.max(F.when(F.col("number") == 1, F.col("nav"))).alias("last"),
            F.max(F.when(F.col("number") == 2, F.col("nav"))).alias("previous"),
        )
    )
    return funds.join(latest, "isin", "left").select(
        "isin", (F.col("last") - F.col("previous") > 0).alias("rising")
    )


def missing_quotes(
    funds: DataFrame,
    open_lots: DataFrame,
    accounts: DataFrame,
    quotes: DataFrame,
    as_of: dt.datetime,
) -> DataFrame:
    """Held funds without the quote expected at ``as_of``; inactive ones apart."""
    expected = expected_quote_date(F.lit(as_of))
    known = quotes.filter(F.col("date") == expected).select("isin", F.lit(True).alias("known"))
    held = funds.join(live_funds(open_lots, accounts, pending=True), "isin", "left_semi")
    active = F.coalesce(F.col("active"), F.lit(False))
    return (
        held.join(known, "isin", "left")
        .filter(~active | F.col("known").isNull())
        .select(
            "isin",
            F.coalesce("alias", "name").alias("alias"),
            expected.alias("expected_date"),
            F.when(active, "missing").otherwise("inactive").alias("state"),
        )
    )


def append_quotes(
    existing: DataFrame, incoming: DataFrame, arrival: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Quotes to append, and the newcomers that lost to a known quote.

    The first arrival per fund and day wins, and a stored quote beats all.
    """
    keys = ["isin", "date"]
    first = incoming.groupBy(*keys).agg(
        F.min(F.struct(*arrival, price(F.col("nav")).alias("_nav"))).alias("_first"),
        F.count("*").alias("_arrivals"),
    )
    stored = existing.select(*keys, F.lit(True).alias("_stored"))
    # Written, so that both results stay as judged when the store changes.
    judged = written(first.join(stored, keys, "left"), "judged")
    accepted = judged.filter(F.col("_stored").isNull()).select(*keys, F.col("_first._nav").alias("nav"))
    refused = F.col("_arrivals") - F.when(F.col("_stored").isNull(), 1).otherwise(0)
    conflicts = judged.select(*keys, refused.alias("refused")).filter(F.col("refused") > 0)
    return accepted, conflicts


def refused_quotes(existing: DataFrame, incoming: DataFrame, arrival: list[str]) -> DataFrame:
    """Every newcomer that ``append_quotes`` does not accept, with its price, its place and the reason.

    Rows equal in fund, day, place and price are one row that tells how many times.
    """
    keys = ["isin", "date"]
    rows = incoming.groupBy(*keys, *arrival, price(F.col("nav")).alias("nav")).agg(F.count("*").alias("times"))
    rows = written(rows, "newcomers")
    first = rows.groupBy(*keys).agg(F.min(F.struct(*arrival, "nav")).alias("_first"))
    # Both sides have one row per fund and day, so a day with many newcomers joins like any other.
    judged = first.join(existing.select(*keys, F.lit(True).alias("_stored")), keys, "left")
    accepted = F.col("_stored").isNull() & F.struct(*arrival, "nav").eqNullSafe(F.col("_first"))
    return (
        rows.join(judged, keys)
        .withColumn("times", F.col("times") - accepted.cast("long"))
        .filter("times > 0")
        .select(*keys, *arrival, "nav", F.when(F.col("_stored"), "stored before").otherwise("came later").alias("reason"), "times")
    )
