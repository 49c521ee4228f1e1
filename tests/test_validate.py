"""Rules that span rows and tables, and missing or repeated keys."""

from builders import accounts, ledger, lots, orders, quotes, rows, sales
from pyspark.sql import functions as F

from lotwise.operators.validate import validate_ledger
from lotwise.schemas import FUND_FEED


def found(it):
    return rows(validate_ledger(it), "table_name", "key", "reason")


def test_an_empty_ledger_breaks_no_rule(spark):
    assert found(ledger(spark)) == []


def test_keys_references_and_sales_of_repeated_lots(spark):
    held = lots(
        spark,
        (1, "a", "2020-01-01", "2020-01-01", 5, 10, None),
        (1, "a", "2020-01-01", "2020-01-02", 9, 10, None),
        (2, "b", "2020-01-01", "2020-01-01", None, 10, None),
        (3, "nobody", "2020-01-01", "2020-01-01", 5, 10, 77),
        (4, "b", "2020-01-01", "2020-01-01", 5, 10, 11),
    )
    sold = sales(spark, (10, 100, 1, 4, 1), (11, 100, 1, 3, 1), (12, 100, 2, 1, 1), (13, 999, 55, 1, 1), (14, 100, 4, 5, 1))
    it = ledger(
        spark,
        accounts=accounts(spark, ("a", "F", "X"), ("b", "F", "X")),
        lots=held,
        sales=sold,
        orders=orders(spark, (100, "2020-02-01")),
        quotes=quotes(spark, ("F", "2020-01-01", 1), ("F", "2020-01-01", 2)),
    )
    assert sorted(found(it)) == sorted([
        ("accounts", "a", "unknown isin"),
        ("accounts", "b", "unknown isin"),
        ("lots", "1", "repeated lot_id"),
        ("lots", "1", "too many shares sold"),  # 7 of 5; the other row of this lot holds 9
        ("lots", "2", "sold with unknown shares"),
        ("lots", "3", "unknown account_id"),
        ("lots", "3", "unknown origin_sale_id"),
        ("lots", "4", "bought before sold"),
        ("quotes", "F/2020-01-01", "repeated isin/date"),
        ("quotes", "F/2020-01-01", "unknown isin"),
        ("quotes", "F/2020-01-01", "unknown isin"),
        ("sales", "100/1", "repeated order_id/lot_id"),
        ("sales", "13", "unknown lot_id"),
        ("sales", "13", "unknown order_id"),
    ])


def test_missing_keys_neither_repeat_nor_lead_anywhere(spark):
    held = lots(spark, *[(1, "a", "2020-01-01", "2020-01-01", 0, 10, None)] * 2)
    nameless = held.withColumns({"lot_id": F.lit(None).cast("long"), "account_id": F.lit(None).cast("string")})
    it = ledger(spark, lots=spark.createDataFrame(nameless.collect(), nameless.schema))
    got = [tuple(r) for r in validate_ledger(it).collect()]
    assert sorted(got, key=str) == [("lots", None, "missing account_id")] * 2 + [("lots", None, "shares not positive")] * 2


def test_keys_of_several_columns_are_compared_column_by_column(spark):
    # Joined to one text, both keys read a/b/c.
    it = ledger(spark, fund_feeds=spark.createDataFrame([("a/b", "c", None), ("a", "b/c", None)], FUND_FEED))
    assert not [row for row in found(it) if "repeated" in row[2]]


def test_keys_are_dealt_out_by_their_own_values_and_broken_rows_not_at_all(spark):
    it = ledger(spark, lots=lots(spark, (1, "a", "2020-01-01", "2020-01-01", 0, 10, None)))
    plan = validate_ledger(it)._jdf.queryExecution().sparkPlan().toString()
    exploded = [line for line in plan.splitlines() if "Generate explode" in line]
    assert exploded and not [line for line in exploded if "domain" in line]
