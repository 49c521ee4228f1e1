"""The ledger as a set of DataFrames, and its Parquet form."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.schemas import LEDGER


@dataclass(frozen=True)
class Ledger:
    """Base tables of one ledger; all operators work on these."""

    feeds: DataFrame
    funds: DataFrame
    fund_feeds: DataFrame
    accounts: DataFrame
    lots: DataFrame
    orders: DataFrame
    sales: DataFrame
    quotes: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {field.name: getattr(self, field.name) for field in fields(self)}


def read_ledger(spark: SparkSession, folder: str) -> Ledger:
    """Open the ledger tables under ``folder`` with their fixed schemas."""
    return Ledger(
        **{
            name: spark.read.schema(schema).parquet(f"{folder}/{name}.parquet")
            for name, schema in LEDGER.items()
        }
    )


_LAYOUT = {"quotes": ["isin", "date"], "lots": ["account_id", "trade_date", "lot_id"], "accounts": ["account_id"]}


def typed(name: str, table: DataFrame) -> DataFrame:
    """The columns of a ledger table with their fixed types."""
    return table.select(*[F.col(field.name).cast(field.dataType).alias(field.name) for field in LEDGER[name]])


def sorted_by(name: str, table: DataFrame) -> DataFrame:
    """A ledger table in the order in which it is stored, if it has one."""
    keys = _LAYOUT.get(name)
    return table.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else table


def write_ledger(ledger: Ledger, folder: str) -> None:
    """Write the ledger tables under ``folder``.

    Quotes are range-sorted by fund and date, lots and accounts by account, so that
    filters on those skip row groups.
    """
    for name, table in ledger.tables().items():
        typed(name, sorted_by(name, table)).write.parquet(f"{folder}/{name}.parquet", compression="zstd")


def scan_tables(ledger: Ledger) -> DataFrame:
    """Row count of each base table, by full scans."""
    counts = [
        table.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, table in ledger.tables().items()
    ]
    result = counts[0]
    for count in counts[1:]:
        result = result.unionByName(count)
    return result
