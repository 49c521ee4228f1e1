"""Streams of quotes: storing them, completing pending rows, live variation.

Pending rows may wait for a price for months and quotes may come late, so no
watermark is used where it would drop them: the tables themselves are the state,
and each micro-batch is judged against them.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lotwise.functions.numbers import growth
from lotwise.operators.resolve import complete_pending
from lotwise.schemas import LOT, SALE
from lotwise.session import discard, written
from lotwise.sources.ledger_text import apply_layout, parse_records
from lotwise.sources.stores import store_quotes
from lotwise.sources.tables import Ledger
from lotwise.streaming import variation_state

# Workers get the helper's code with the task, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(variation_state)

# Days of a batch that are named one by one when tables are filtered.
LISTED_DAYS = 400
PENDING_LOT = T.StructType([*LOT.fields, T.StructField("isin", T.StringType())])
PENDING_SALE = T.StructType(
    [*SALE.fields, T.StructField("trade_date", T.DateType()), T.StructField("isin", T.StringType())]
)


# One run over what there is; any other trigger of a streaming query may be given instead.
ONCE = {"availableNow": True}


def quote_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Quotes from pipe-separated files as they appear in ``folder``, with the time and path of their file."""
    reader = spark.readStream
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    arrival = F.struct("_metadata.file_modification_time", "_metadata.file_path")
    lines = reader.text(folder).select("value", arrival.alias("place"))
    quotes = apply_layout(parse_records(lines), "quote")[0].filter(F.col("nav").isNotNull())
    return quotes.withColumnRenamed("place", "arrival")


def _arrival(quotes: DataFrame) -> list[str]:
    """Order in which quotes arrived: by file if that is known, then by price."""
    return [c for c in ("arrival",) if c in quotes.columns] + ["nav"]


def _days(batch: DataFrame, column: str = "date") -> Column:
    """Condition on a date column that holds for the days of a batch; few days are listed."""
    found = batch.select("date").distinct().limit(LISTED_DAYS + 1).collect()
    if len(found) <= LISTED_DAYS:
        return F.col(column).isin([r["date"] for r in found])
    low, high = batch.agg(F.min("date"), F.max("date")).first()
    return F.col(column).between(low, high)


def _run(stream: DataFrame, checkpoint: str, each_batch, trigger: dict) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(each_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def stream_quote_ingest(
    quotes: DataFrame, store: str, checkpoint: str, trigger: dict = ONCE
) -> StreamingQuery:
    """Store the first quote per fund and day; later ones lose to the stored one.

    Within a batch the quote of the older file comes first, then the lower price.
    """
    arrival = _arrival(quotes)

    def ingest(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        store_quotes(store, batch, arrival, _days(batch))
        batch.unpersist()

    return _run(quotes, checkpoint, ingest, trigger)


def write_pending(ledger: Ledger, folder: str) -> str:
    """Write lots and sales that wait for a price, sorted by trade date, with the fund they wait for.

    Files and row groups hold ranges of days, so a filter on days skips the others.
    """
    funds = ledger.accounts.select("account_id", "isin")
    lots = ledger.lots.filter(F.col("cost").isNull() | F.col("initial_shares").isNull()).join(funds, "account_id")
    sales = (
        ledger.sales.filter(F.col("proceeds").isNull())
        .join(ledger.orders.select("order_id", "trade_date"), "order_id")
        .join(ledger.lots.select("lot_id", "account_id"), "lot_id")
        .join(funds, "account_id")
    )
    for name, table in (("lots", lots), ("sales", sales)):
        days = table.repartitionByRange("trade_date").sortWithinPartitions("trade_date")
        days.write.mode("append").parquet(f"{folder}/{name}")
    return folder


def _append(rows: DataFrame, path: str, column: str) -> None:
    """Append rows in files and row groups that hold ranges of ``column``."""
    rows.repartitionByRange(column).sortWithinPartitions(column).write.mode("append").parquet(path)


def stream_backfill(
    quotes: DataFrame, pending: str, completed_lots: str, completed_sales: str, checkpoint: str, trigger: dict = ONCE
) -> StreamingQuery:
    """Complete pending lots and sales (``write_pending``) whenever their price arrives.

    Only row groups with the batch's days are read, anew for every batch, so rows
    may be added to the pending tables while the stream runs. Completed rows are
    appended to two tables, sorted by day and by id, of which only the part that can
    hold rows of the batch is read. Rows already there are not looked at again, which
    also makes a repeated batch harmless.
    """
    spark = quotes.sparkSession
    arrival = _arrival(quotes)

    def complete(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        days = _days(batch, "trade_date")
        first = batch.groupBy("isin", "date").agg(F.min_by("nav", F.struct(*arrival)).alias("nav"))
        lots = spark.read.schema(PENDING_LOT).parquet(f"{pending}/lots").filter(days)
        sales = spark.read.schema(PENDING_SALE).parquet(f"{pending}/sales").filter(days)
        lots, sales = (written(rows, "completed") for rows in complete_pending(first, lots, sales))
        done_lots = spark.read.schema(LOT).parquet(completed_lots).filter(days)
        # Completed sales have no day; only files and row groups with ids of this batch are read.
        low, high = sales.agg(F.min("sale_id"), F.max("sale_id")).first()
        done_sales = spark.read.schema(SALE).parquet(completed_sales).filter(F.col("sale_id").between(low, high))
        new_lots = written(lots.join(done_lots.select("lot_id"), "lot_id", "left_anti"), "lots")
        new_sales = written(sales.join(done_sales.select("sale_id"), "sale_id", "left_anti"), "sales")
        _append(new_lots.select(*LOT.fieldNames()), completed_lots, "trade_date")
        _append(new_sales.select(*SALE.fieldNames()), completed_sales, "sale_id")
        batch.unpersist()
        discard(lots, sales, new_lots, new_sales)

    return _run(quotes, checkpoint, complete, trigger)


def live_variation(quotes: DataFrame) -> DataFrame:
    """Percent change of each quote to the one before, as quotes arrive.

    The state of a fund is its newest quote. A quote older than that is ignored;
    the batch view is the truth for late ones. Of several quotes of a day in a batch the
    first that arrived counts, as in the store.
    """
    if "arrival" in quotes.columns:
        arrived = quotes["arrival.file_modification_time"], quotes["arrival.file_path"]
    else:
        arrived = F.lit(None).cast("timestamp"), F.lit(None).cast("string")
    named = [column.alias(name) for column, name in zip(arrived, variation_state.ARRIVAL)]
    pairs = quotes.select("isin", "date", "nav", *named).groupBy("isin").applyInPandasWithState(
        variation_state.variations,
        outputStructType="isin string, date date, nav decimal(12,4), previous decimal(12,4)",
        stateStructType="date date, nav decimal(12,4)",
        outputMode="append",
        timeoutConf="NoTimeout",
    )
    change = growth(F.col("nav"), F.col("previous")) * 100
    return pairs.select("isin", "date", "nav", change.alias("variation"))


def stream_variation(quotes: DataFrame, output: str, checkpoint: str, trigger: dict = ONCE) -> StreamingQuery:
    """Append live variations to the table at ``output``."""
    return (
        live_variation(quotes)
        .writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**trigger)
        .start()
    )


def empty_table(spark: SparkSession, path: str, schema) -> str:
    """Create an empty Parquet table for a stream to append to."""
    spark.createDataFrame([], schema).write.parquet(path)
    return path

