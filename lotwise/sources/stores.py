"""Tables that grow or change: quotes and fund feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.operators.quotes import append_quotes
from lotwise.schemas import QUOTE


def store_quotes(path: str, incoming: DataFrame, arrival: list[str], days: Column | None = None) -> DataFrame:
    """Append new quotes to the table at ``path``; returns refused keys with counts.

    Running it again with the same input appends nothing, so a batch that was
    cut short can be repeated. ``days`` is a condition on ``date`` that holds for all
    incoming quotes; with it, only that part of the store is read.
    """
    existing = incoming.sparkSession.read.schema(QUOTE).parquet(path)
    existing = existing if days is None else existing.filter(days)
    accepted, refused = append_quotes(existing, incoming, arrival)
    accepted.write.mode("append").parquet(path)
    return refused


def upsert_fund_feed(
    funds: DataFrame, fund_feeds: DataFrame, updates: DataFrame, order: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Change the feed of funds and the key that a fund has in its feed.

    ``updates`` has isin, feed (NULL keeps it), feed_key and sets_key. A key that
    differs from the effective one is stored for the new feed, a NULL key is
    removed there. A fund without any feed keeps having none. Of several updates of
    a fund the last by the ``order`` columns holds; equal ones are told apart by
    their values.
    """
    wanted = ["isin", "feed", "feed_key", "sets_key"]
    by = F.struct(*(order or []), "sets_key", "feed", "feed_key")
    updates = updates.groupBy("isin").agg(F.max_by(F.struct(*wanted[1:]), by).alias("_u")).select("isin", "_u.*")
    effective = fund_feeds.select("feed", "isin", F.col("feed_key").alias("_stored"))
    current = funds.join(effective, ["feed", "isin"], "left").select(
        "isin", F.col("feed").alias("_feed"), F.coalesce("_stored", "isin").alias("_key")
    )
    change = updates.join(current, "isin").select(
        "isin",
        F.coalesce("feed", "_feed").alias("feed"),
        F.when(F.col("sets_key"), F.col("feed_key")).otherwise(F.col("_key")).alias("new_key"),
        (F.col("sets_key") & (F.col("feed_key") != F.col("_key"))).alias("_stores"),
        (F.col("feed") != F.col("_feed")).alias("_moves"),
    )
    keys = change.filter(
        F.col("feed").isNotNull() & (F.coalesce("_stores", F.lit(False)) | F.col("new_key").isNull())
    ).select("feed", "isin", "new_key", F.lit(True).alias("_changed"))
    feeds = (
        fund_feeds.join(keys, ["feed", "isin"], "full_outer")
        .select(
            "feed", "isin", F.when(F.col("_changed"), F.col("new_key")).otherwise(F.col("feed_key")).alias("feed_key"),
            (F.col("_changed") & F.col("new_key").isNull()).alias("_removed"),
        )
        .filter(~F.coalesce("_removed", F.lit(False)))
        .drop("_removed")
    )
    moved = change.filter("_moves").select("isin", F.col("feed").alias("_new_feed"))
    changed_funds = (
        funds.join(moved, "isin", "left")
        .withColumn("feed", F.coalesce("_new_feed", "feed"))
        .select(*funds.columns)
    )
    return changed_funds, feeds


def insert_funds(
    funds: DataFrame, fund_feeds: DataFrame, new: DataFrame, order: list[str] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Add funds given with their feed key; known funds stay as they are.

    Of several rows of a fund the first by the ``order`` columns is added. A key is
    only stored when it differs from the isin, which is the default. The third
    result has the rows that were not added, with the reason.
    """
    columns = [c for c in new.columns if c not in (order or [])]
    place = F.struct(*(order or []), F.struct(*columns).alias("_row"))
    counted = new.groupBy(*new.columns).agg(F.count("*").alias("_n")).withColumn("_place", place)
    first = counted.groupBy("isin").agg(F.min("_place").alias("_first"))
    known = funds.select("isin", F.lit(True).alias("_known"))
    judged = counted.join(first, "isin").join(known, "isin", "left")
    taken = F.col("_known").isNull() & (F.col("_place") == F.col("_first"))
    reason = F.when(F.col("_known"), "known fund").otherwise("repeated fund")
    copies = F.array_repeat(reason, (F.col("_n") - F.when(taken, 1).otherwise(0)).cast("int"))
    refused = judged.select(*columns, F.explode(copies).alias("reason"))
    added = first.join(funds.select("isin"), "isin", "left_anti").select("_first._row.*")
    keys = added.filter((F.col("feed_key") != F.col("isin")) & F.col("feed").isNotNull())
    return (
        funds.unionByName(added.select(*funds.columns)),
        fund_feeds.unionByName(keys.select(*fund_feeds.columns)),
        refused,
    )
