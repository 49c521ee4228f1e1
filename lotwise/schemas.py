"""Fixed schemas of the ledger tables and the value types they use."""

from pyspark.sql import types as T

SHARES = T.DecimalType(18, 5)
MONEY = T.DecimalType(18, 2)
NAV = T.DecimalType(12, 4)
# Ratios are cut to twelve decimals before they multiply anything.
RATIO = T.DecimalType(18, 12)


def _table(*fields):
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


FUND = _table(
    ("isin", T.StringType(), False),
    ("name", T.StringType(), False),
    ("alias", T.StringType(), True),
    ("manager", T.StringType(), True),
    ("currency", T.StringType(), False),
    ("risk", T.IntegerType(), True),
    ("feed", T.StringType(), True),
    ("active", T.BooleanType(), True),
)
FEED = _table(("feed", T.StringType(), False))
FUND_FEED = _table(
    ("feed", T.StringType(), False),
    ("isin", T.StringType(), False),
    ("feed_key", T.StringType(), True),
)
ACCOUNT = _table(
    ("account_id", T.StringType(), False),
    ("isin", T.StringType(), False),
    ("distributor", T.StringType(), False),
)
LOT = _table(
    ("lot_id", T.LongType(), False),
    ("account_id", T.StringType(), False),
    ("invest_date", T.DateType(), False),
    ("trade_date", T.DateType(), False),
    ("initial_shares", SHARES, True),
    ("cost", MONEY, True),
    ("origin_sale_id", T.LongType(), True),
)
SALE_ORDER = _table(
    ("order_id", T.LongType(), False),
    ("trade_date", T.DateType(), False),
    ("comment", T.StringType(), True),
)
SALE = _table(
    ("sale_id", T.LongType(), False),
    ("order_id", T.LongType(), False),
    ("lot_id", T.LongType(), False),
    ("shares", SHARES, True),
    ("proceeds", MONEY, True),
)
QUOTE = _table(
    ("isin", T.StringType(), False),
    ("date", T.DateType(), False),
    ("nav", NAV, False),
)

LEDGER = {
    "feeds": FEED,
    "funds": FUND,
    "fund_feeds": FUND_FEED,
    "accounts": ACCOUNT,
    "lots": LOT,
    "orders": SALE_ORDER,
    "sales": SALE,
    "quotes": QUOTE,
}

# Sums keep room for ten thousand billion rows and still multiply exactly.
TOTAL_SHARES = T.DecimalType(24, 5)
TOTAL_MONEY = T.DecimalType(28, 2)
VALUE = T.DecimalType(31, 9)
