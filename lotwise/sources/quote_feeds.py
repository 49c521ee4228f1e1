"""Quote files of the two feed formats, partitioned by fund (``isin=…``).

One file is one response: the quotes of one fund, bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.functions.numbers import price

# Formats of the two feeds.
CSV_TIMESTAMP = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"  # one to six digits of a second
JSON_SCHEMA = (
    "body struct<content: struct<_list: array<struct<nested: struct<body: struct<vars: struct<data:"
    " array<struct<rowDateRaw: bigint, last_closeRaw: string>>>>>>>>>, isin string"
)


def _judged(rows: DataFrame) -> DataFrame:
    """Rows (isin, line, date, nav) with the reason why one is no quote."""
    reason = F.coalesce(
        F.col("reason"), F.when(F.col("date").isNull(), "bad date"), F.when(F.col("nav").isNull(), "bad nav")
    )
    return rows.withColumn("reason", reason)


def _accepted(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("reason").isNull()).select("isin", "date", "nav")


def _refused(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("reason").isNotNull()).select("isin", "line", "reason")


def _csv_rows(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.schema("value string, isin string").text(folder, wholetext=True)
    lines = F.split("value", "\n")
    cells = F.split("line", ";")
    rows = files.select(
        "isin", F.explode(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0)))).alias("line")
    ).select(
        "isin",
        "line",
        F.to_date(F.try_to_timestamp(F.get(cells, F.lit(0)), F.lit(CSV_TIMESTAMP))).alias("date"),
        price(F.regexp_replace(F.get(cells, F.lit(1)), ",", ".").try_cast("decimal(18,6)")).alias("nav"),
        F.when(F.size(cells) < 2, "too few fields").alias("reason"),
    )
    return _judged(rows)


def _json_rows(spark: SparkSession, folder: str) -> DataFrame:
    block = F.try_element_at("body.content._list", F.lit(-2))
    data = block["nested"]["body"]["vars"]["data"]
    # A response without the block gives one row that holds the reason.
    found = (
        spark.read.option("multiLine", True)
        .schema(JSON_SCHEMA)
        .json(folder)
        .select("isin", data.isNull().alias("missing"), F.explode_outer(data).alias("row"))
        .filter(F.col("missing") | F.col("row").isNotNull())
    )
    return _judged(
        found.select(
            "isin",
            F.to_json("row").alias("line"),
            F.to_date(F.timestamp_seconds("row.rowDateRaw")).alias("date"),
            price(F.col("row.last_closeRaw").try_cast("decimal(18,6)")).alias("nav"),
            F.when(F.col("missing"), "no quotes in the response").alias("reason"),
        )
    )


def read_quote_csv_feed(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes with decimal commas; the first and last line of a file are no quotes."""
    return _accepted(_csv_rows(spark, folder))


def read_quote_json_feed(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes nested in the last but one block of a response; dates are UTC."""
    return _accepted(_json_rows(spark, folder))


def rejected_csv_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of CSV responses that are no quotes: isin, line, reason."""
    return _refused(_csv_rows(spark, folder))


def rejected_json_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of JSON responses that are no quotes, and responses without any: isin, line, reason."""
    return _refused(_json_rows(spark, folder))
