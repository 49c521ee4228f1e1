"""Pipe-separated operation records, one layout per kind of record.

Cells are trimmed, empty cells are NULL, trailing optional cells may be
missing. A row that does not fit its layout is set apart with the reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.operators.running import row_numbers
from lotwise.session import written

# The words that mean yes and no.
YES_WORDS = ("y", "yes", "t", "true", "on", "1")
NO_WORDS = ("n", "no", "f", "false", "off", "0")
WHOLE_NUMBER = r"^[+-]?\d+$"


@dataclass(frozen=True)
class Field:
    """One cell: its name, kind, whether it must be given, and its default."""

    name: str
    kind: str = "string"
    required: bool = True
    default: str | None = None


def _optional(name: str, kind: str = "string", default: str | None = None) -> Field:
    return Field(name, kind, False, default)


# "quantity" is a whole number of lots or a decimal number of shares.
LAYOUTS: dict[str, list[Field]] = {
    "fund": [
        Field("isin"),
        Field("name"),
        Field("alias", required=False),
        Field("manager", required=False),
        Field("feed", required=False),
        Field("risk", "int", required=False),
        _optional("active", "boolean", "0"),
        _optional("currency", default="EUR"),
        _optional("feed_key"),
    ],
    "account": [Field("account_id"), Field("isin"), Field("distributor")],
    "subscription": [
        Field("account_id"),
        Field("trade_date", "date"),
        _optional("cost", "decimal(18,2)"),
        _optional("shares", "decimal(18,5)"),
    ],
    "redemption": [
        Field("account_id"),
        Field("trade_date", "date"),
        Field("quantity", "quantity", required=False),
        _optional("proceeds", "decimal(18,2)"),
        _optional("comment"),
    ],
    "transfer": [
        Field("account_id"),
        Field("sell_date", "date"),
        Field("destination"),
        _optional("buy_date", "date"),
        _optional("quantity", "quantity"),
        _optional("proceeds", "decimal(18,2)"),
        _optional("bought_shares", "decimal(18,5)"),
        _optional("comment"),
    ],
    "quote": [Field("isin"), Field("date", "date"), _optional("nav", "decimal(12,4)")],
    "quote_range": [Field("isin"), Field("first_date", "date"), _optional("last_date", "date")],
}
# Cells that a row needs at least; those after may be left out.
SHORTEST = {
    "fund": 6,
    "account": 3,
    "subscription": 2,
    "redemption": 3,
    "transfer": 3,
    "quote": 2,
    "quote_range": 2,
}


def parse_records(lines: DataFrame) -> DataFrame:
    """Rows of a text column ``value`` as trimmed cells, without comments and blanks."""
    line = F.col("value")
    cells = F.transform(F.split(line, r"\|"), lambda cell: F.nullif(F.trim(cell), F.lit("")))
    place = ["place"] if "place" in lines.columns else []
    return lines.filter(~line.startswith("#") & (F.trim(line) != "")).select(
        line.alias("line"), cells.alias("cells"), *place
    )


def read_ledger_file(spark: SparkSession, path: str) -> DataFrame:
    """Records of pipe-separated files."""
    return parse_records(spark.read.text(path))


def _number(cell: Column, kind: str) -> Column:
    """A decimal cell; shares with more decimals are cut, everything else is rounded."""
    if kind != "decimal(18,5)":
        return cell.try_cast(kind)
    return F.floor(cell.try_cast("decimal(38,18)"), F.lit(5)).try_cast(kind)


def _typed(field: Field, cell: Column) -> dict[str, Column]:
    if field.default is not None:
        cell = F.coalesce(cell, F.lit(field.default))
    if field.kind == "quantity":
        whole = cell.rlike(WHOLE_NUMBER)
        return {
            "lots": F.when(whole, cell.try_cast("int")),
            "shares": F.when(~whole, _number(cell, "decimal(18,5)")),
        }
    if field.kind == "boolean":
        word = F.lower(cell)
        return {field.name: F.when(word.isin(*YES_WORDS), True).when(word.isin(*NO_WORDS), False)}
    if field.kind.startswith("decimal"):
        return {field.name: _number(cell, field.kind)}
    return {field.name: cell.try_cast(field.kind)}


def apply_layout(records: DataFrame, layout: str) -> tuple[DataFrame, DataFrame]:
    """Typed rows of a layout, and the rejected lines with the reason."""
    fields = LAYOUTS[layout]
    size = F.size("cells")
    values: dict[str, Column] = {}
    problems = [
        F.when(size < SHORTEST[layout], "too few fields"),
        F.when(size > len(fields), "too many fields"),
    ]
    for number, field in enumerate(fields):
        cell = F.get("cells", F.lit(number))
        typed = _typed(field, cell)
        values.update(typed)
        if field.required:
            problems.append(F.when(cell.isNull(), f"missing {field.name}"))
        unread = F.coalesce(*[value.cast("string") for value in typed.values()]).isNull()
        problems.append(F.when(cell.isNotNull() & unread, f"bad {field.name}"))
        if field.kind == "quantity":
            amount = F.coalesce(typed["shares"], typed["lots"].cast("decimal(18,5)"))
            problems.append(F.when(amount <= 0, f"{field.name} not positive"))
    place = ["place"] if "place" in records.columns else []
    rows = records.select(
        "line", F.coalesce(*problems).alias("reason"), *[v.alias(n) for n, v in values.items()], *place
    )
    if layout == "quote_range":
        reversed_range = F.col("last_date") < F.col("first_date")
        rows = rows.withColumn("reason", F.coalesce("reason", F.when(reversed_range, "last date before first")))
    accepted = rows.filter(F.col("reason").isNull()).drop("line", "reason")
    return accepted, rows.filter(F.col("reason").isNotNull()).select("line", "reason")


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their place: file, start of the part read by one task, line within it."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    place = F.struct("file_path", "file_block_start", F.monotonically_increasing_id().alias("row"))
    return lines.select("value", place.alias("place"))


def read_operations(
    spark: SparkSession, subscriptions: str, redemptions: str, transfers: str, first_id: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Operations of the three kinds of text files, and their rejected lines: file, line, reason.

    Ids count from ``first_id`` through purchases, redemptions and transfers, each in
    file order. The result is a log for ``replay_ledger``.
    """
    found, rejected = [], []
    for number, (layout, path) in enumerate(
        [("subscription", subscriptions), ("redemption", redemptions), ("transfer", transfers)]
    ):
        rows, refused = apply_layout(parse_records(_placed(spark, path)), layout)
        names = {"sell_date": "trade_date", "cost": "money", "proceeds": "money"}
        rows = rows.withColumnsRenamed({a: b for a, b in names.items() if a in rows.columns})
        found.append(rows.withColumns({"kind": F.lit(layout), "_kind": F.lit(number)}))
        rejected.append(refused.select(F.lit(layout).alias("file"), "line", "reason"))
    # Written, so that ids are given once for lines that are read once.
    rows = found[0].unionByName(found[1], allowMissingColumns=True).unionByName(found[2], allowMissingColumns=True)
    rows = written(rows, "records").select("*", "place.*")
    tiers = [["_kind"], ["file_path"], ["file_block_start"]]
    numbered = row_numbers(rows, [], tiers, ["row"], "_number")
    ops = numbered.select(
        (F.col("_number") + (first_id - 1)).alias("op_id"),
        *["kind", "account_id", "trade_date", "lots", "shares", "money", "destination", "buy_date", "bought_shares", "comment"],
    )
    return ops, rejected[0].unionByName(rejected[1]).unionByName(rejected[2])


def read_layout(spark: SparkSession, path: str, layout: str) -> tuple[DataFrame, DataFrame]:
    """Typed rows of a file, and its rejected lines."""
    return apply_layout(read_ledger_file(spark, path), layout)


def wanted_quotes(ranges: DataFrame) -> DataFrame:
    """Every fund and date that the ranges ask for; an open range is one day."""
    last = F.coalesce("last_date", "first_date")
    return ranges.select("isin", F.explode(F.sequence("first_date", last)).alias("date")).distinct()


def range_requests(ranges: DataFrame) -> DataFrame:
    """Ranges as a closing date and the days before it."""
    return ranges.select(
        "isin",
        F.coalesce("last_date", "first_date").alias("end_date"),
        F.datediff("last_date", "first_date").alias("days"),
    )
