"""Every operator as a named query over the derived ledger, with its SQL twin."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.operators import allocate as al
from lotwise.operators import evolution as ev
from lotwise.operators import filters as fl
from lotwise.operators import lineage as ln
from lotwise.operators import lots as lt
from lotwise.operators import quotes as qt
from lotwise.operators import resolve as rs
from lotwise.operators import valuation as vl
from lotwise.operators.replay import Replayed, next_id, replay_ledger
from lotwise.operators.validate import validate_ledger, validate_orders
from lotwise.plans import operations as op
from lotwise.plans import oracle, reports
from lotwise.plans import files
from lotwise.schemas import LOT, SALE
from lotwise.schemas import QUOTE as QUOTE_TABLE
from lotwise.session import configure, discard, new_path, settled, written
from lotwise.sources import ledger_text as tx
from lotwise.sources import quote_feeds, stores
from lotwise.sources.derived import input_stamp, stored_ledger
from lotwise.sources.tables import Ledger, scan_tables
from lotwise.streaming import quotes as sq

START, END = "1997-01-01", "1999-12-31"
# The last day with prices for operations that come after END.
PRICED = "2000-12-31"
AS_OF = dt.datetime(2001, 10, 21, 23, 0)

_stored_lineage: dict[tuple, DataFrame] = {}


@dataclass
class Inputs:
    """What a query may read: the ledger tables and the written lineage."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def ledger(self) -> Ledger:
        return stored_ledger(self.spark, self.sf_dir)

    @cached_property
    def lineage(self) -> DataFrame:
        """Lineage as a table, written once per application."""
        key = input_stamp(self.spark, self.sf_dir)
        if key not in _stored_lineage:
            _stored_lineage[key] = settled(ln.lineage(self.ledger), "lineage-all")
        return _stored_lineage[key]

    @cached_property
    def open_lots(self) -> DataFrame:
        return lt.open_lots(self.ledger.lots, self.ledger.sales)

    @cached_property
    def account_sales(self) -> DataFrame:
        return lt.account_sales(self.ledger.sales, self.ledger.orders, self.ledger.lots)

    @cached_property
    def account_transfers(self) -> DataFrame:
        return lt.account_transfers(self.ledger.sales, self.ledger.orders, self.ledger.lots)

    @cached_property
    def gains(self) -> DataFrame:
        return ln.fiscal_gains(self.lineage)

    def between(self, start: str | None, end: str | None) -> DataFrame:
        return vl.portfolio_between(self.lineage, self.ledger, _date(start), _date(end))

    def evolution(self, period: str, shown: bool = False) -> DataFrame:
        """All chains from the first purchase to the day of the report."""
        return ev.evolution(self.lineage, self.ledger.lots, self.ledger.quotes, period, AS_OF.date(), shown=shown)


@dataclass(frozen=True)
class Query:
    """A query: its result columns, its Spark form and, if it has one, its SQL."""

    columns: str
    build: Callable[[Inputs], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        result = self.build(Inputs(configure(spark), sf_dir))
        casts = {"n": "double", "d": "string", "i": "bigint", "b": "boolean", "s": "string"}
        return result.select(
            *[F.col(name).cast(casts[kind]).alias(name) for name, kind in oracle.columns_of(self.columns)]
        )


QUERIES: dict[str, Query] = {}


def _date(text: str | None) -> dt.date | None:
    return None if text is None else dt.date.fromisoformat(text)


def query(name: str, columns: str, sql: str | None = None, *views: str):
    """Register a builder under ``name``."""

    def register(build: Callable[[Inputs], DataFrame]):
        text = None if sql is None else oracle.statement(sql, columns, *views)
        QUERIES[name] = Query(columns, build, text)
        return build

    return register


# --- tables, filters and views ------------------------------------------------

query(
    "scan_tables",
    "table_name rows:i",
    """SELECT 'funds' AS table_name, count(*) AS rows FROM fund UNION ALL SELECT 'feeds', count(*) FROM feed UNION ALL
SELECT 'fund_feeds', count(*) FROM fund_feed UNION ALL SELECT 'accounts', count(*) FROM account UNION ALL
SELECT 'lots', count(*) FROM lot UNION ALL SELECT 'orders', count(*) FROM sale_order UNION ALL
SELECT 'sales', count(*) FROM sale UNION ALL SELECT 'quotes', count(*) FROM quote""",
)(lambda i: scan_tables(i.ledger))

FUND = "isin name alias manager currency risk:i feed feed_key active:b"
query("fund_view", FUND, "SELECT * FROM fund_view")(
    lambda i: lt.fund_view(i.ledger.funds, i.ledger.fund_feeds)
)
query("filter_funds", FUND, "SELECT * FROM fund_view WHERE active")(
    lambda i: fl.filter_funds(lt.fund_view(i.ledger.funds, i.ledger.fund_feeds), active=True)
)
query(
    "filter_accounts",
    "account_id isin distributor",
    "SELECT * FROM account WHERE account_id = '5-FX0000000001-B0'",
)(lambda i: fl.filter_accounts(i.ledger.accounts, "5-FX0000000001-B0"))
QUOTE = "isin date:d nav:n"
query(
    "filter_quotes",
    QUOTE,
    f"""SELECT * FROM quote WHERE isin = 'FX0000000003' AND date BETWEEN DATE '{START}' AND DATE '{END}'
ORDER BY date DESC LIMIT 50""",
)(lambda i: fl.filter_quotes(i.ledger.quotes, "FX0000000003", _date(START), _date(END), 50))

OPEN_LOT = (
    "lot_id:i account_id invest_date:d trade_date:d initial_shares:n shares:n cost:n origin_sale_id:i"
)
query("open_lots", OPEN_LOT, "SELECT * FROM open_lot")(lambda i: i.open_lots)
query(
    "filter_lots",
    OPEN_LOT,
    "SELECT * FROM open_lot WHERE (shares IS NULL OR shares > 0) AND origin_sale_id IS NOT NULL",
)(lambda i: fl.filter_lots(i.open_lots, alive=True, new_money=False))
query(
    "sales",
    "sale_id:i order_id:i lot_id:i trade_date:d shares:n proceeds:n comment",
    "SELECT * FROM sale_view",
)(lambda i: lt.sale_view(i.ledger.sales, i.ledger.orders))
query(
    "transfers",
    "sale_id:i order_id:i lot_id:i sell_date:d sold_shares:n proceeds:n destination buy_date:d bought_shares:n comment",
    "SELECT * FROM transfer_view",
)(lambda i: lt.transfer_view(i.ledger.sales, i.ledger.orders, i.ledger.lots))

ACCOUNT_SALE = "order_id:i account_id trade_date:d lots:i shares:n proceeds:n comment"
query("account_sales", ACCOUNT_SALE, "SELECT * FROM account_sale")(lambda i: i.account_sales)
query(
    "filter_sales",
    ACCOUNT_SALE,
    """SELECT * FROM account_sale WHERE order_id NOT IN (
  SELECT order_id FROM sale JOIN lot ON origin_sale_id = sale_id)""",
)(lambda i: fl.filter_sales(i.account_sales, i.ledger.sales, i.ledger.lots, redeemed=True))
TRANSFER = (
    "order_id:i source sell_date:d destination buy_date:d lots:i sold_shares:n proceeds:n bought_shares:n comment"
)
query("account_transfers", TRANSFER, "SELECT * FROM account_transfer")(lambda i: i.account_transfers)
query(
    "filter_transfers",
    TRANSFER,
    "SELECT * FROM account_transfer WHERE source = '5-FX0000000001-B0'",
)(lambda i: fl.filter_transfers(i.account_transfers, source="5-FX0000000001-B0"))
query("distributor_switches", "lot_id:i buy_date:d isin", "SELECT * FROM switch")(
    lambda i: lt.distributor_switches(i.ledger.lots, i.ledger.sales, i.ledger.accounts)
)
query(
    "commission",
    "lot_id:i isin trade_date:d shares:n nav:n cost:n commission:n active:b",
    f"""SELECT lot_id, isin, trade_date, shares, nav, cost, cost - ({oracle.worth("shares", "nav")}) AS commission,
       shares > 0 AS active
FROM open_lot JOIN account USING (account_id)
LEFT JOIN (SELECT isin, date AS trade_date, nav FROM quote) USING (isin, trade_date)""",
)(lambda i: lt.commission(i.ledger.lots, i.ledger.sales, i.ledger.accounts, i.ledger.quotes))

# --- quotes -------------------------------------------------------------------

query(
    "last_quote",
    QUOTE,
    f"SELECT isin, max(date) AS date, arg_max(nav, date) AS nav FROM quote WHERE date <= DATE '{END}' GROUP BY isin",
)(lambda i: qt.last_quote(i.ledger.quotes, _date(END)))

VARIATION = "isin date:d nav:n variation:n number:i"
VARIATION_SQL = """SELECT isin, date, nav, round(CAST(nav AS DOUBLE) / CAST(previous AS DOUBLE) - 1, 4) * 100 AS variation, number
FROM (SELECT *, lead(nav) OVER w AS previous, row_number() OVER w AS number
      FROM quote WHERE isin IN (SELECT isin FROM account JOIN open_lot USING (account_id) WHERE shares > 0)
      WINDOW w AS (PARTITION BY isin ORDER BY date DESC))
WHERE previous IS NOT NULL"""
query("quote_variation", VARIATION, f"{VARIATION_SQL} AND number <= 5")(
    lambda i: qt.quote_variation(i.open_lots, i.ledger.accounts, i.ledger.quotes, 5)
)
query("filter_variations", VARIATION, f"SELECT * FROM ({VARIATION_SQL}) WHERE number <= 1")(
    lambda i: fl.filter_variations(
        qt.quote_variation(i.open_lots, i.ledger.accounts, i.ledger.quotes), 1
    )
)
query(
    "quote_history",
    "isin date:d nav:n change_percent:n sign",
    """SELECT isin, date, nav, round((CAST(nav AS DOUBLE) / CAST(previous AS DOUBLE) - 1) * 100, 2) AS change_percent,
       CASE WHEN round(CAST(nav AS DOUBLE) / CAST(previous AS DOUBLE), 5) < 1 THEN '-' ELSE '+' END AS sign
FROM (SELECT *, coalesce(lead(nav) OVER w, nav) AS previous, row_number() OVER w AS number
      FROM quote WINDOW w AS (PARTITION BY isin ORDER BY date DESC)) WHERE number <= 10""",
)(lambda i: qt.quote_history(i.ledger.quotes))
TREND_SQL = """trend AS (
  SELECT isin, (SELECT q.nav - q.previous > 0 FROM (
    SELECT isin, nav, lead(nav) OVER w AS previous, row_number() OVER w AS number
    FROM quote WINDOW w AS (PARTITION BY isin ORDER BY date DESC)) q
    WHERE q.isin = fund.isin AND number = 1) AS rising
  FROM fund)"""
query("fund_trend", "isin rising:b", "SELECT * FROM trend", TREND_SQL)(
    lambda i: qt.fund_trend(i.ledger.funds, i.ledger.quotes)
)
query(
    "missing_quotes",
    "isin alias expected_date:d state",
    """SELECT isin, alias, DATE '2001-10-19' AS expected_date,
       CASE WHEN active THEN 'missing' ELSE 'inactive' END AS state
FROM fund_view
WHERE isin IN (SELECT isin FROM account JOIN open_lot USING (account_id) WHERE shares IS NULL OR shares > 0)
  AND (NOT active OR isin NOT IN (SELECT isin FROM quote WHERE date = DATE '2001-10-19'))""",
)(
    lambda i: qt.missing_quotes(
        i.ledger.funds, i.open_lots, i.ledger.accounts, i.ledger.quotes, AS_OF
    )
)

# --- portfolio, lineage and gains ---------------------------------------------

PORTFOLIO = "isin distributor capital:n shares:n weight:n date:d nav:n valuation:n gain:n"
query("portfolio", PORTFOLIO, "SELECT * FROM portfolio")(lambda i: vl.portfolio(i.ledger))
query(
    "report_with_totals",
    "line distributor capital:n valuation:n gain_percent:n",
    """SELECT isin AS line, distributor, capital, valuation,
       round((CAST(valuation - capital AS DOUBLE) / CAST(capital AS DOUBLE)) * 100, 2) AS gain_percent FROM portfolio
UNION ALL
SELECT 'TOTAL', NULL, sum(capital), sum(valuation),
       round((CAST(sum(valuation) - sum(capital) AS DOUBLE) / CAST(sum(capital) AS DOUBLE)) * 100, 2) FROM portfolio""",
)(lambda i: reports.report_with_totals(vl.portfolio(i.ledger)))
query(
    "totals_by_currency",
    "currency positions:i capital:n valuation:n gain_percent:n",
    """SELECT currency, count(*) AS positions, sum(capital) AS capital, sum(valuation) AS valuation,
       round((CAST(sum(valuation) - sum(capital) AS DOUBLE) / CAST(sum(capital) AS DOUBLE)) * 100, 2) AS gain_percent
FROM portfolio JOIN fund USING (isin) GROUP BY currency""",
)(lambda i: reports.totals_by_currency(vl.portfolio(i.ledger), i.ledger.funds))

LINEAGE = (
    "terminal_lot:i order_id:i hop:i lot_id:i account_id isin invest_date:d trade_date:d end_date:d fraction:n"
    " cost:n nav:n shares:n proceeds:n origin_lot:i capital:n"
)
query("lineage", LINEAGE, "SELECT * FROM lineage")(lambda i: ln.lineage(i.ledger))
query(
    "filter_lineage",
    LINEAGE,
    "SELECT * FROM lineage WHERE order_id <> 0 AND terminal_lot = lot_id",
)(
    lambda i: fl.filter_lineage(
        ln.lineage(i.ledger, redeemed=True), terminal_only=True, redeemed=True
    )
)
GAIN = (
    "terminal_lot:i order_id:i account_id isin origin_lot:i invest_date:d end_date:d capital:n shares:n"
    " proceeds:n gain:n"
)
query("fiscal_gains", GAIN, "SELECT * FROM gains")(lambda i: i.gains)
query("filter_gains", GAIN, "SELECT * FROM gains WHERE order_id = 0")(
    lambda i: fl.filter_gains(i.gains, order_id=0)
)
query(
    "enriched_lineage",
    "terminal_lot:i order_id:i lot_id:i account_id distributor isin alias invest_date:d trade_date:d end_date:d"
    " shares:n proceeds:n",
    """SELECT l.*, a.distributor, f.alias FROM lineage l JOIN account a USING (account_id)
JOIN fund_view f ON f.isin = l.isin""",
)(lambda i: ln.enriched_lineage(i.lineage, i.ledger.accounts, i.ledger.funds))
query(
    "gain_report",
    "line year:i alias distributor account_id capital:n invest_date:d end_date:d shares:n proceeds:n gain:n"
    " gain_percent:n annual_percent:n",
    """SELECT terminal_lot || '/' || order_id AS line, NULL AS year, alias, distributor, account_id, capital,
       invest_date, end_date, shares, proceeds, gain, (CAST(gain AS DOUBLE) / CAST(capital AS DOUBLE)) * 100 AS gain_percent,
       CAST(printf('%.8e', annual) AS DOUBLE) AS annual_percent
FROM (SELECT *, CASE WHEN gain = 0 THEN 0 WHEN end_date = invest_date THEN NULL
      ELSE (pow(1 + CAST(gain AS DOUBLE) / CAST(capital AS DOUBLE), 365.0 / (end_date - invest_date)) - 1) * 100 END AS annual
      FROM gains) JOIN account a USING (account_id) JOIN fund_view f ON f.isin = a.isin WHERE order_id <> 0
UNION ALL
SELECT 'TOTAL', year(end_date), NULL, NULL, NULL, sum(capital), NULL, NULL, NULL, sum(proceeds), sum(gain),
       (CAST(sum(gain) AS DOUBLE) / CAST(sum(capital) AS DOUBLE)) * 100, NULL
FROM gains WHERE order_id <> 0 AND end_date IS NOT NULL GROUP BY year(end_date)""",
)(
    # Power functions differ in the last bits, so yearly rates keep nine digits.
    lambda i: reports.gain_report(i.gains, i.ledger, redeemed=True).withColumn(
        "annual_percent",
        F.when(F.col("annual_percent").isNotNull(), F.format_string("%.8e", "annual_percent").cast("double")),
    )
)
query(
    "tax_due",
    "year:i gain:n rate:n tax:n",
    """SELECT year, gain, rate, round(greatest(gain, 0) * rate, 2) AS tax FROM (
  SELECT year(end_date) AS year, sum(gain) AS gain,
         CAST(CASE WHEN sum(gain) < 6000 THEN 0.19 WHEN sum(gain) <= 50000 THEN 0.21 ELSE 0.23 END AS DECIMAL(3, 2)) AS rate
  FROM gains WHERE order_id <> 0 AND gain IS NOT NULL GROUP BY year(end_date))""",
)(lambda i: reports.tax_due(i.gains))

CHAIN_VALUE = "terminal_lot:i account_id date:d nav:n shares:n initial:n capital:n"
query("chain_value", CHAIN_VALUE, "SELECT * FROM chain_value", oracle.between(START, END))(
    lambda i: vl.chain_value(i.lineage, i.ledger, _date(START), _date(END))
)
BETWEEN = f"account_id prior_gain:n {PORTFOLIO}"
query("portfolio_between", BETWEEN, "SELECT * FROM portfolio_between", oracle.between(START, END))(
    lambda i: i.between(START, END)
)
query("portfolio_since_purchase", BETWEEN, "SELECT * FROM portfolio_between", oracle.between(None, None))(
    lambda i: i.between(None, None)
)
query(
    "filter_portfolio",
    BETWEEN,
    "SELECT * FROM portfolio_between WHERE distributor = 'B0' AND (shares IS NULL OR shares > 0)",
    oracle.between(None, END),
)(lambda i: fl.filter_portfolio(i.between(None, END), distributor="B0", alive=True))
query(
    "portfolio_report",
    "alias isin risk:i account_id distributor prior_gain:n capital:n shares:n weight_percent:n date:d nav:n"
    " rising:b gain:n gain_percent:n",
    """SELECT alias, p.isin, risk, account_id, distributor, prior_gain, capital, shares, weight * 100 AS weight_percent,
       date, nav, rising, valuation - capital AS gain, gain * 100 AS gain_percent
FROM portfolio_between p JOIN fund_view f ON f.isin = p.isin JOIN trend t ON t.isin = p.isin WHERE shares > 0
UNION ALL
SELECT 'TOTAL', NULL, NULL, NULL, NULL, sum(prior_gain), sum(capital), NULL, 100, NULL, NULL, NULL,
       sum(valuation - capital), round((CAST(sum(valuation - capital) AS DOUBLE) / CAST(sum(capital) AS DOUBLE)) * 100, 2)
FROM portfolio_between WHERE shares > 0""",
    oracle.between(START, None),
    TREND_SQL,
)(lambda i: reports.portfolio_report(i.between(START, None), i.ledger))

EVOLUTION = (
    "period terminal_lot:i order_id:i lot_id:i cost:n trade_date:d end_date:d shares:n isin date:d value:n"
)
EVOLUTION_VIEWS = oracle.evolution("months")
query("evolution", EVOLUTION, "SELECT * FROM evolution", EVOLUTION_VIEWS)(lambda i: i.evolution("months", shown=True))
query("evolution_weeks", EVOLUTION, "SELECT * FROM evolution", oracle.evolution("weeks"))(
    lambda i: i.evolution("weeks", shown=True)
)
query(
    "filter_evolution",
    EVOLUTION,
    "SELECT * FROM evolution WHERE terminal_lot IS NULL OR terminal_lot IN (SELECT max(terminal_lot) FROM evolution)",
    EVOLUTION_VIEWS,
)(lambda i: _filtered_evolution(i))
query(
    "return_series",
    "series date:d return:n",
    """SELECT terminal_lot || '/' || order_id AS series, date, CAST(value AS DOUBLE) / CAST(cost AS DOUBLE) - 1 AS return
FROM evolution WHERE terminal_lot IS NOT NULL""",
    EVOLUTION_VIEWS,
)(lambda i: ev.return_series(i.evolution("months", shown=True)))


def _ticks_sql(rows: str) -> str:
    return f"""SELECT tick, CASE WHEN monthly AND month(tick) > 1 THEN strftime(tick, '%b') ELSE strftime(tick, '%Y') END AS label
FROM (
  SELECT monthly, CAST(unnest(CASE WHEN monthly
    THEN generate_series(CAST(date_trunc('month', low) AS TIMESTAMP) + INTERVAL 1 MONTH, CAST(high AS TIMESTAMP), INTERVAL 1 MONTH)
    ELSE generate_series(CAST(date_trunc('year', low) AS TIMESTAMP) + INTERVAL 1 YEAR, CAST(high AS TIMESTAMP), INTERVAL 1 YEAR)
    END) AS DATE) AS tick
  FROM (SELECT min(date) AS low, max(date) AS high, year(max(date)) - year(min(date)) <= 2 AS monthly
        FROM {rows}))"""


query(
    "axis_ticks", "tick:d label", _ticks_sql("evolution WHERE terminal_lot IS NOT NULL"), EVOLUTION_VIEWS
)(lambda i: ev.axis_ticks(i.evolution("months")))
query(
    "axis_ticks_months",
    "tick:d label",
    _ticks_sql(
        """evolution WHERE terminal_lot IS NOT NULL AND date >
        (SELECT CAST(max(date) - INTERVAL 18 MONTH AS DATE) FROM evolution WHERE terminal_lot IS NOT NULL)"""
    ),
    EVOLUTION_VIEWS,
)(lambda i: ev.axis_ticks(_newest_months(i.evolution("months"), 18)))


def _newest_months(evolution: DataFrame, months: int) -> DataFrame:
    """The days of the end of a set of series: as many months before its newest day.

    Written, so that the series are sampled once for the newest day and the days before it.
    """
    series = evolution.filter(F.col("terminal_lot").isNotNull())
    days = written(series.groupBy("date").agg(F.max("terminal_lot").alias("terminal_lot")), "days")
    return days.filter(F.col("date") > F.add_months(F.lit(days.agg(F.max("date")).first()[0]), -months))


def _filtered_evolution(i: Inputs) -> DataFrame:
    """The series of the newest chain, with the axis."""
    evolution = i.evolution("months")
    newest = evolution.agg(F.max("terminal_lot")).first()[0]
    return fl.filter_evolution(evolution, axis=True, terminal_lot=newest)


# --- operations ---------------------------------------------------------------

query(
    "resolve_subscriptions",
    "lot_id:i account_id invest_date:d trade_date:d initial_shares:n cost:n origin_sale_id:i",
    f"""SELECT o.lot_id, o.account_id, CASE WHEN o.origin_sale_id IS NULL THEN o.trade_date ELSE p.invest_date END AS invest_date,
       o.trade_date, coalesce(CASE WHEN o.lot_id % 3 <> 0 THEN o.initial_shares END, {oracle.shares_for("o.cost", "q.nav")}) AS initial_shares,
       coalesce(CASE WHEN o.lot_id % 3 <> 1 THEN o.cost END, {oracle.money(oracle.worth("o.initial_shares", "q.nav"))}) AS cost,
       o.origin_sale_id
FROM lot o JOIN account a ON a.account_id = o.account_id
LEFT JOIN quote q ON q.isin = a.isin AND q.date = o.trade_date AND q.date <= DATE '{END}'
LEFT JOIN sale s ON s.sale_id = o.origin_sale_id LEFT JOIN lot p ON p.lot_id = s.lot_id""",
)(
    lambda i: rs.resolve_subscriptions(
        op.subscription_ops(i.ledger.lots),
        i.ledger.accounts,
        op.known_quotes(i.ledger.quotes, _date(END)),
        i.ledger.sales,
        i.ledger.lots,
    )
)

RESOLVED_SALES = f"""
gap_lot AS (
  SELECT lot_id, account_id, CASE WHEN lot_id % 7 <> 0 THEN initial_shares END
    - coalesce((SELECT sum(v.shares) FROM sale_view v WHERE v.lot_id = lot.lot_id AND v.trade_date <= DATE '{END}'), 0) AS left_shares
  FROM lot),
sale_op AS (
  SELECT sale_id * 4 AS sale_id, order_id, lot_id, trade_date, CASE WHEN sale_id % 3 <> 0 THEN shares END AS shares,
         CASE WHEN sale_id % 3 = 2 THEN proceeds END AS proceeds FROM sale_view WHERE trade_date > DATE '{END}'
  UNION ALL SELECT sale_id * 4 + 1, order_id, lot_id, trade_date, NULL, NULL FROM sale_view WHERE trade_date > DATE '{END}'
  UNION ALL SELECT sale_id * 4 + 2, order_id, lot_id, DATE '{END}' + 1, NULL, NULL FROM sale_view WHERE trade_date <= DATE '{END}'),
sale_line AS (
  SELECT o.*, g.account_id, g.left_shares,
         CASE WHEN count(*) FILTER (shares IS NULL) OVER w = 0
           THEN greatest(left_shares - coalesce(sum(shares) OVER w, 0), 0) ELSE 0 END AS rest
  FROM sale_op o JOIN gap_lot g USING (lot_id)
  WINDOW w AS (PARTITION BY lot_id ORDER BY trade_date, sale_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
resolved AS (
  SELECT sale_id, order_id, lot_id, account_id, isin, trade_date, sold AS shares,
         coalesce(proceeds, {oracle.money(oracle.worth("sold", "nav"))}) AS proceeds,
         CASE WHEN left_shares IS NULL THEN 'lot shares unknown' WHEN shares IS NULL AND sold = 0 THEN 'nothing left' END AS reason
  FROM (SELECT s.*, a.isin, q.nav,
               coalesce(s.shares, CASE WHEN left_shares IS NOT NULL THEN CAST(rest AS DECIMAL(18, 5)) END) AS sold
        FROM sale_line s JOIN account a ON a.account_id = s.account_id
        LEFT JOIN quote q ON q.isin = a.isin AND q.date = s.trade_date))"""
query(
    "resolve_sales",
    "sale_id:i order_id:i lot_id:i account_id isin trade_date:d shares:n proceeds:n reason",
    "SELECT * FROM resolved",
    RESOLVED_SALES,
)(
    lambda i: rs.resolve_sales(
        op.sale_ops(i.ledger.sales, i.ledger.orders, _date(END)),
        lt.open_lots(
            op.lots_with_gaps(i.ledger.lots), op.sales_until(i.ledger.sales, i.ledger.orders, _date(END))
        ),
        i.ledger.accounts,
        i.ledger.quotes,
    )
)


@query(
    "resolve_transfers",
    "sale_id:i shares:n proceeds:n reason account_id invest_date:d trade_date:d initial_shares:n cost:n",
    f"""SELECT sale_id, shares, proceeds, reason,
       CASE WHEN takes THEN destination END AS account_id, CASE WHEN takes THEN invest_date END AS invest_date,
       CASE WHEN takes THEN buy_date END AS trade_date,
       CASE WHEN takes THEN coalesce(bought, {oracle.shares_for("proceeds", "buy_nav")}) END AS initial_shares,
       CASE WHEN takes THEN coalesce(proceeds, {oracle.money(oracle.worth("bought", "buy_nav"))}) END AS cost
FROM (SELECT *, destination IS NOT NULL AND reason IS NULL AS takes FROM (
  SELECT *, CASE WHEN asked IS NULL AND shares = 0 THEN 'nothing left' WHEN destination IS NULL THEN NULL
                 WHEN buy_date < sell_date THEN 'bought before sold'
                 WHEN bought IS NULL AND proceeds IS NULL THEN 'no price for the sale' END AS reason FROM (
    SELECT t.*, q2.nav AS buy_nav, l.invest_date,
           coalesce(t.given_proceeds, {oracle.money(oracle.worth("t.shares", "q1.nav"))}) AS proceeds,
           coalesce(t.bought_shares, CASE WHEN t.given_proceeds IS NULL AND buy_date = sell_date AND a2.isin = a1.isin THEN shares END) AS bought
    FROM (SELECT o.*, coalesce(asked, CAST(CASE WHEN count(*) FILTER (asked IS NULL) OVER w = 0
                        THEN greatest(initial_shares - coalesce(sum(asked) OVER w, 0), 0) ELSE 0 END AS DECIMAL(18, 5))) AS shares
          FROM (SELECT sale_id * 2 AS sale_id, lot_id, sell_date, destination, CASE WHEN sale_id % 2 = 0 THEN sold_shares END AS asked,
                       CASE WHEN sale_id % 4 = 0 THEN proceeds END AS given_proceeds,
                       coalesce(CASE WHEN sale_id % 11 = 0 THEN buy_date - 1 WHEN sale_id % 3 = 0 THEN buy_date END, sell_date) AS buy_date,
                       CASE WHEN sale_id % 5 = 0 THEN bought_shares END AS bought_shares
                FROM transfer_view WHERE sell_date > DATE '{END}'
                UNION ALL SELECT sale_id * 2 + 1, lot_id, sell_date, destination, NULL, NULL, sell_date, NULL
                FROM transfer_view WHERE sell_date > DATE '{END}' AND sale_id % 7 = 0) o JOIN lot USING (lot_id)
          WINDOW w AS (PARTITION BY lot_id ORDER BY sell_date, sale_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) t
    JOIN lot l USING (lot_id) JOIN account a1 ON a1.account_id = l.account_id
    LEFT JOIN account a2 ON a2.account_id = t.destination
    LEFT JOIN quote q1 ON q1.isin = a1.isin AND q1.date = t.sell_date AND q1.date <= DATE '{PRICED}'
    LEFT JOIN quote q2 ON q2.isin = a2.isin AND q2.date = t.buy_date AND q2.date <= DATE '{PRICED}')))""",
)
def _resolve_transfers(i: Inputs) -> DataFrame:
    ledger = i.ledger
    transfers = lt.transfer_view(ledger.sales, ledger.orders, ledger.lots)
    sales, bought = rs.resolve_transfers(
        op.transfer_ops(transfers, _date(END)),
        ledger.lots,
        lt.open_lots(ledger.lots, op.sales_until(ledger.sales, ledger.orders, _date(END))),
        ledger.accounts,
        op.known_quotes(ledger.quotes, _date(PRICED)),
    )
    return sales.select("sale_id", "shares", "proceeds", "reason").join(
        bought.withColumnRenamed("origin_sale_id", "sale_id"), "sale_id", "left"
    )


FILLED = "kind id:i shares:n amount:n"
FILLED_SQL = f"""SELECT 'lot' AS kind, lot_id AS id,
       CASE WHEN lot_id % 3 = 0 THEN {oracle.shares_for("cost", "nav")} ELSE initial_shares END AS shares,
       CASE WHEN lot_id % 3 = 1 THEN {oracle.money(oracle.worth("initial_shares", "nav"))} ELSE cost END AS amount
FROM lot JOIN account USING (account_id) JOIN quote q USING (isin)
WHERE q.date = trade_date AND q.date > DATE '{START}' AND lot_id % 3 <> 2
UNION ALL
SELECT 'sale', sale_id, s.shares, {oracle.money(oracle.worth("s.shares", "nav"))}
FROM sale_view s JOIN lot l USING (lot_id) JOIN account USING (account_id) JOIN quote q USING (isin)
WHERE q.date = s.trade_date AND q.date > DATE '{START}' AND sale_id % 2 <> 0"""


def filled_rows(lots: DataFrame, sales: DataFrame) -> DataFrame:
    """Completed lots and sales as one list."""
    return lots.select(
        F.lit("lot").alias("kind"), F.col("lot_id").alias("id"), F.col("initial_shares").alias("shares"), F.col("cost").alias("amount")
    ).unionByName(
        sales.select(
            F.lit("sale").alias("kind"), F.col("sale_id").alias("id"), "shares", F.col("proceeds").alias("amount")
        )
    )


@query("backfill_on_quote", FILLED, FILLED_SQL)
def _backfill(i: Inputs) -> DataFrame:
    lots, sales = op.pending(i.ledger.lots, i.ledger.sales)
    arriving = i.ledger.quotes.filter(F.col("date") > F.lit(_date(START)))
    return filled_rows(
        *rs.backfill_on_quote(arriving, lots, sales, i.ledger.orders, i.ledger.accounts)
    )


query(
    "assign_order_ids",
    "op_id:i trade_date:d order_id:i is_new:b",
    f"""SELECT sale_id AS op_id, trade_date, order_id, false AS is_new FROM sale_view WHERE trade_date <= DATE '{END}'
UNION ALL
SELECT sale_id, trade_date, row_number() OVER (ORDER BY trade_date, sale_id)
         + (SELECT max(order_id) FROM sale_order WHERE trade_date <= DATE '{END}'), true
FROM sale_view WHERE trade_date > DATE '{END}'""",
)(
    lambda i: rs.assign_order_ids(
        lt.sale_view(i.ledger.sales, i.ledger.orders).select(
            F.col("sale_id").alias("op_id"),
            "trade_date",
            F.when(F.col("trade_date") <= F.lit(_date(END)), F.col("order_id")).alias("order_id"),
        ),
        i.ledger.orders.filter(F.col("trade_date") <= F.lit(_date(END))),
    )
)

ALLOCATED = "order_id:i lot_id:i shares:n proceeds:n bought_shares:n reason"


def _allocation_stages(by_shares: bool) -> str:
    """Three orders per account one after the other, each from what is left."""
    amounts = (
        ("CAST(floor(total * 0.3 * 100000) / 100000 AS DECIMAL(18, 5))", "CAST(floor(total * 0.5 * 100000) / 100000 AS DECIMAL(18, 5))", "NULL")
        if by_shares
        else ("1", "2", "1")
    )
    views = ["""left0 AS (SELECT lot_id, account_id, invest_date, trade_date, shares FROM open_lot WHERE shares > 0),
owner AS (SELECT account_id, min(lot_id) AS first, sum(initial_shares) AS total FROM lot GROUP BY account_id)"""]
    for k, (date, amount) in enumerate(zip(op.ORDER_DATES, amounts)):
        size = "shares" if by_shares else "1"
        money = f"CAST({1000 + k} AS DECIMAL(18, 2))" if k < 2 else "CAST(NULL AS DECIMAL(18, 2))"
        bought = "CAST(100 AS DECIMAL(18, 5))" if k == 0 else "CAST(NULL AS DECIMAL(18, 5))"
        views.append(f"""reach{k} AS (
  SELECT l.*, {size} AS size, sum({size}) OVER (PARTITION BY account_id ORDER BY invest_date, lot_id ROWS UNBOUNDED PRECEDING) AS hi,
         sum({size}) OVER (PARTITION BY account_id) AS visible
  FROM left{k} l WHERE trade_date <= DATE '{date}'),
ask{k} AS (
  SELECT account_id, first * 10 + {k} AS order_id, {amount} AS amount, coalesce(visible, 0) AS visible
  FROM owner LEFT JOIN (SELECT DISTINCT account_id, visible FROM reach{k}) USING (account_id)),
take{k} AS (
  SELECT order_id, lot_id, CAST({"least(hi, coalesce(amount, a.visible)) - (hi - size)" if by_shares else "shares"} AS DECIMAL(18, 5)) AS shares
  FROM reach{k} r JOIN ask{k} a USING (account_id)
  WHERE coalesce(amount, a.visible) <= a.visible AND hi - size < coalesce(amount, a.visible)),
sold{k} AS (SELECT *, sum(shares) OVER (PARTITION BY order_id) AS whole FROM take{k}),
done{k} AS (
  SELECT order_id, lot_id, shares, {oracle.money(oracle.scaled(money, oracle.ratio("shares", "whole")))} AS proceeds,
         CAST(floor(({oracle.scaled(bought, oracle.ratio("shares", "whole")).replace("19, 2", "19, 5")}) * 100000) / 100000 AS DECIMAL(18, 5)) AS bought_shares,
         CAST(NULL AS VARCHAR) AS reason
  FROM sold{k}
  UNION ALL
  SELECT order_id, NULL, NULL, NULL, NULL,
         '{"too many shares" if by_shares else "too many lots"}'
  FROM ask{k} WHERE visible = 0 OR amount > visible),
left{k + 1} AS (
  SELECT lot_id, account_id, invest_date, trade_date, CAST(l.shares - coalesce(t.shares, 0) AS DECIMAL(18, 5)) AS shares
  FROM left{k} l LEFT JOIN take{k} t USING (lot_id) WHERE l.shares - coalesce(t.shares, 0) > 0)""")
    return ",\n".join(views)


def _allocated(result: tuple[DataFrame, DataFrame]) -> DataFrame:
    sales, refused = result
    return sales.unionByName(refused, allowMissingColumns=True)


ALLOCATED_SQL = "SELECT * FROM done0 UNION ALL SELECT * FROM done1 UNION ALL SELECT * FROM done2"
query("fifo_allocate_shares", ALLOCATED, ALLOCATED_SQL, _allocation_stages(by_shares=True))(
    lambda i: _allocated(al.fifo_allocate_shares(op.share_orders(i.ledger.lots), i.open_lots))
)
query("fifo_allocate_lots", ALLOCATED, ALLOCATED_SQL, _allocation_stages(by_shares=False))(
    lambda i: _allocated(al.fifo_allocate_lots(op.lot_orders(i.ledger.lots), i.open_lots))
)


REPLAYED = "kind id:i parent:i date:d shares:n amount:n reason"


def _listed(done: Replayed) -> DataFrame:
    """All results of a replay as one list."""
    parts = [
        done.lots.select(F.lit("lot").alias("kind"), F.col("lot_id").alias("id"), F.col("origin_sale_id").alias("parent"),
                         F.col("trade_date").alias("date"), F.col("initial_shares").alias("shares"), F.col("cost").alias("amount")),
        done.orders.select(F.lit("order").alias("kind"), F.col("order_id").alias("id"), F.col("trade_date").alias("date")),
        done.sales.select(F.lit("sale").alias("kind"), F.col("sale_id").alias("id"), F.col("lot_id").alias("parent"),
                          "shares", F.col("proceeds").alias("amount")),
        done.refused.select(F.lit("refused").alias("kind"), F.col("op_id").alias("id"), "reason"),
    ]
    result = parts[0].withColumn("reason", F.lit(None).cast("string"))
    for table in parts[1:]:
        result = result.unionByName(table, allowMissingColumns=True)
    return result


@query("replay_ledger", REPLAYED)
def _replay(i: Inputs) -> DataFrame:
    log = written(op.operation_log(i.ledger.lots, i.account_transfers), "log")
    return _listed(replay_ledger(log, i.ledger.accounts, i.ledger.quotes))


@query("replay_increment", REPLAYED)
def _replay_increment(i: Inputs) -> DataFrame:
    """The log up to a day, then the rest on top of what it led to: the same rows as in one go."""
    log = written(op.operation_log(i.ledger.lots, i.account_transfers), "log")
    early = F.col("trade_date") <= F.lit(_date(END))
    first_id = (log.agg(F.max("op_id")).first()[0] or 0) + 1
    before = replay_ledger(log.filter(early), i.ledger.accounts, i.ledger.quotes, first_id=first_id)
    stored = Ledger(
        **{**i.ledger.tables(), "lots": written(before.lots, "lots"), "orders": before.orders, "sales": written(before.sales, "sales")}
    )
    after = replay_ledger(
        log.filter(~early), i.ledger.accounts, i.ledger.quotes, stored, next_id(stored, first_id)
    )
    return _listed(replace(before, lots=stored.lots, sales=stored.sales)).unionByName(_listed(after))


BROKEN = """
blot0 AS (
  SELECT lot_id, CASE WHEN lot_id % 109 = 0 THEN 'nobody' ELSE account_id END AS account_id,
         CASE WHEN lot_id % 149 <> 0 THEN invest_date END AS invest_date,
         CASE WHEN lot_id % 113 = 0 THEN trade_date - 1 ELSE trade_date END AS trade_date,
         CASE WHEN lot_id % 101 = 0 THEN 0 WHEN lot_id % 103 = 0 THEN NULL WHEN lot_id % 107 = 0 THEN 1
              ELSE initial_shares END AS initial_shares,
         CASE WHEN lot_id % 103 <> 0 OR lot_id % 2 = 0 THEN cost END AS cost, origin_sale_id FROM lot),
blot AS (SELECT * FROM blot0 UNION ALL SELECT * FROM blot0 WHERE lot_id % 131 = 0),
bsale0 AS (
  SELECT sale_id, order_id, lot_id,
         CASE WHEN sale_id % 101 = 1 THEN 0 WHEN sale_id % 103 = 1 THEN NULL ELSE shares END AS shares,
         CASE WHEN sale_id % 107 = 1 THEN -1 WHEN sale_id % 103 <> 1 OR sale_id % 2 = 0 THEN proceeds END AS proceeds
  FROM sale WHERE sale_id % 127 <> 0),
bsale AS (SELECT * FROM bsale0 UNION ALL SELECT * FROM bsale0 WHERE sale_id % 131 = 0),
border AS (SELECT order_id, CASE WHEN order_id % 151 <> 0 THEN trade_date END AS trade_date, comment
  FROM sale_order WHERE order_id % 137 <> 0),
bfeed AS (SELECT * FROM feed WHERE feed <> 'json'),
bquote AS (SELECT * FROM quote UNION ALL SELECT * FROM quote WHERE day(date) = 31),
bfund AS (SELECT * FROM fund WHERE active),
bleft AS (
  SELECT l.*, l.initial_shares - coalesce((SELECT sum(shares) FROM bsale s WHERE s.lot_id = l.lot_id), 0) AS left_shares
  FROM blot l)"""
BROKEN_SQL = """SELECT 'lots' AS table_name, CAST(lot_id AS VARCHAR) AS key, 'shares not positive' AS reason FROM blot WHERE initial_shares <= 0
UNION ALL SELECT 'lots', CAST(lot_id AS VARCHAR), 'neither shares nor cost' FROM blot WHERE initial_shares IS NULL AND cost IS NULL
UNION ALL SELECT 'sales', CAST(sale_id AS VARCHAR), 'shares not positive' FROM bsale WHERE shares <= 0
UNION ALL SELECT 'sales', CAST(sale_id AS VARCHAR), 'proceeds negative' FROM bsale WHERE proceeds < 0
UNION ALL SELECT 'sales', CAST(sale_id AS VARCHAR), 'neither shares nor proceeds' FROM bsale WHERE shares IS NULL AND proceeds IS NULL
UNION ALL SELECT 'lots', CAST(lot_id AS VARCHAR), 'repeated lot_id' FROM blot GROUP BY lot_id HAVING count(*) > 1
UNION ALL SELECT 'lots', concat_ws('/', origin_sale_id, account_id, trade_date), 'repeated origin_sale_id/account_id/trade_date'
  FROM blot WHERE origin_sale_id IS NOT NULL GROUP BY origin_sale_id, account_id, trade_date HAVING count(*) > 1
UNION ALL SELECT 'orders', CAST(order_id AS VARCHAR), 'repeated order_id' FROM border GROUP BY order_id HAVING count(*) > 1
UNION ALL SELECT 'sales', CAST(sale_id AS VARCHAR), 'repeated sale_id' FROM bsale GROUP BY sale_id HAVING count(*) > 1
UNION ALL SELECT 'sales', concat_ws('/', order_id, lot_id), 'repeated order_id/lot_id' FROM bsale GROUP BY order_id, lot_id HAVING count(*) > 1
UNION ALL SELECT 'quotes', concat_ws('/', isin, date), 'repeated isin/date' FROM bquote GROUP BY isin, date HAVING count(*) > 1
UNION ALL SELECT 'lots', CAST(lot_id AS VARCHAR), 'missing invest_date' FROM blot WHERE invest_date IS NULL
UNION ALL SELECT 'orders', CAST(order_id AS VARCHAR), 'missing trade_date' FROM border WHERE trade_date IS NULL
UNION ALL SELECT 'funds', isin, 'unknown feed' FROM bfund WHERE feed NOT IN (SELECT feed FROM bfeed)
UNION ALL SELECT 'fund_feeds', concat_ws('/', feed, isin), 'unknown feed' FROM fund_feed WHERE feed NOT IN (SELECT feed FROM bfeed)
UNION ALL SELECT 'fund_feeds', concat_ws('/', feed, isin), 'unknown isin' FROM fund_feed WHERE isin NOT IN (SELECT isin FROM bfund)
UNION ALL SELECT 'accounts', account_id, 'unknown isin' FROM account WHERE isin NOT IN (SELECT isin FROM bfund)
UNION ALL SELECT 'lots', CAST(lot_id AS VARCHAR), 'unknown account_id' FROM blot WHERE account_id NOT IN (SELECT account_id FROM account)
UNION ALL SELECT 'lots', CAST(lot_id AS VARCHAR), 'unknown origin_sale_id' FROM blot WHERE origin_sale_id NOT IN (SELECT sale_id FROM bsale)
UNION ALL SELECT 'sales', CAST(sale_id AS VARCHAR), 'unknown lot_id' FROM bsale WHERE lot_id NOT IN (SELECT lot_id FROM blot)
UNION ALL SELECT 'sales', CAST(sale_id AS VARCHAR), 'unknown order_id' FROM bsale WHERE order_id NOT IN (SELECT order_id FROM border)
UNION ALL SELECT 'quotes', concat_ws('/', isin, date), 'unknown isin' FROM bquote WHERE isin NOT IN (SELECT isin FROM bfund)
UNION ALL SELECT 'lots', CAST(l.lot_id AS VARCHAR), 'bought before sold' FROM blot l JOIN bsale s ON s.sale_id = l.origin_sale_id
  JOIN border o USING (order_id) WHERE l.trade_date < o.trade_date
UNION ALL SELECT 'lots', CAST(lot_id AS VARCHAR), 'too many shares sold' FROM bleft WHERE left_shares < 0
UNION ALL SELECT 'lots', CAST(lot_id AS VARCHAR), 'sold with unknown shares' FROM bleft
  WHERE initial_shares IS NULL AND lot_id IN (SELECT lot_id FROM bsale)
UNION ALL SELECT 'orders', CAST(order_id AS VARCHAR), 'both lots and shares' FROM account_transfer WHERE order_id % 7 = 0"""


@query("validate_ledger", "table_name key reason", BROKEN_SQL, BROKEN)
def _validate(i: Inputs) -> DataFrame:
    orders = i.account_transfers.select(
        "order_id", "lots", F.when(F.col("order_id") % 7 == 0, F.col("sold_shares")).alias("shares")
    )
    return validate_ledger(op.broken_ledger(i.ledger)).unionByName(validate_orders(orders))


# --- text records and feeds ---------------------------------------------------

query(
    "read_ledger_file",
    "isin date nav cells:i",
    "SELECT isin, CAST(date AS VARCHAR) AS date, CAST(nav AS VARCHAR) AS nav, 3 AS cells FROM quote",
)(
    lambda i: tx.read_ledger_file(i.spark, files.quote_file(i.ledger.quotes)).select(
        F.col("cells")[0].alias("isin"), F.col("cells")[1].alias("date"), F.col("cells")[2].alias("nav"),
        F.size("cells").alias("cells"),
    )
)


def _layout(i: Inputs, layout: str, path: str) -> DataFrame:
    return tx.read_layout(i.spark, path, layout)[0]


query(
    "layout_fund",
    FUND,
    """SELECT isin, name, alias, manager, CASE WHEN active THEN 'EUR' ELSE 'USD' END AS currency, risk, feed,
       (SELECT feed_key FROM fund_feed k WHERE k.feed = fund.feed AND k.isin = fund.isin) AS feed_key, active FROM fund""",
)(lambda i: _layout(i, "fund", files.fund_file(i.ledger.funds, i.ledger.fund_feeds)))
query("layout_account", "account_id isin distributor", "SELECT * FROM account")(
    lambda i: _layout(i, "account", files.account_file(i.ledger.accounts))
)
query(
    "layout_subscription",
    "account_id trade_date:d cost:n shares:n",
    """SELECT account_id, trade_date, CASE WHEN lot_id % 3 <> 1 THEN cost END AS cost,
       CASE WHEN lot_id % 3 <> 0 THEN initial_shares END AS shares FROM lot""",
)(lambda i: _layout(i, "subscription", files.subscription_file(op.subscription_ops(i.ledger.lots))))
query(
    "layout_redemption",
    "account_id trade_date:d lots:i shares:n proceeds:n comment",
    """SELECT account_id, trade_date, CASE WHEN order_id % 2 = 0 THEN lots END AS lots,
       CASE WHEN order_id % 2 = 1 THEN shares END AS shares, proceeds, comment FROM account_sale""",
)(lambda i: _layout(i, "redemption", files.redemption_file(i.account_sales)))
query(
    "layout_transfer",
    "account_id sell_date:d destination buy_date:d lots:i shares:n proceeds:n bought_shares:n comment",
    """SELECT source AS account_id, sell_date, destination, buy_date, CASE WHEN order_id % 2 = 0 THEN lots END AS lots,
       CASE WHEN order_id % 2 = 1 THEN sold_shares END AS shares, proceeds, bought_shares, comment
FROM account_transfer WHERE destination IS NOT NULL""",
)(lambda i: _layout(i, "transfer", files.transfer_file(i.account_transfers)))
query("layout_quote", QUOTE, "SELECT * FROM quote")(
    lambda i: _layout(i, "quote", files.quote_file(i.ledger.quotes))
)
query(
    "layout_quote_range",
    "isin end_date:d days:i wanted:i",
    """SELECT isin, max(date) AS end_date, max(date) - min(date) AS days, max(date) - min(date) + 1 AS wanted
FROM quote GROUP BY isin, year(date)""",
)(lambda i: _quote_ranges(i))


def _quote_ranges(i: Inputs) -> DataFrame:
    ranges = _layout(i, "quote_range", files.quote_range_file(i.ledger.quotes))
    wanted = tx.wanted_quotes(ranges).groupBy("isin", F.year("date").alias("year")).agg(F.count("*").alias("wanted"))
    return tx.range_requests(ranges).withColumn("year", F.year("end_date")).join(wanted, ["isin", "year"])


query(
    "rejected_rows",
    "line reason",
    """SELECT account_id || CASE WHEN lot_id % 3 = 0 THEN '' WHEN lot_id % 3 = 1 THEN '|1999-02-30|5.00' ELSE '|1999-02-03|5.00|1|x' END AS line,
       CASE lot_id % 3 WHEN 0 THEN 'too few fields' WHEN 1 THEN 'bad trade_date' ELSE 'too many fields' END AS reason FROM lot""",
)(lambda i: tx.read_layout(i.spark, files.bad_subscription_file(i.ledger.lots), "subscription")[1])

query(
    "ingest_text_ledger",
    "kind account_id trade_date:d lots:i shares:n money:n destination buy_date:d bought_shares:n comment",
    """SELECT 'subscription' AS kind, account_id, trade_date, NULL AS lots, CASE WHEN lot_id % 3 <> 0 THEN initial_shares END AS shares,
       CASE WHEN lot_id % 3 <> 1 THEN cost END AS money, NULL AS destination, NULL AS buy_date, NULL AS bought_shares, NULL AS comment
FROM lot WHERE origin_sale_id IS NULL
UNION ALL SELECT CASE WHEN destination IS NULL THEN 'redemption' ELSE 'transfer' END, source, sell_date,
       CASE WHEN order_id % 2 = 0 THEN lots END, CASE WHEN order_id % 2 = 1 THEN sold_shares END, proceeds,
       destination, buy_date, bought_shares, comment FROM account_transfer""",
)(lambda i: _ingested(i))


def _ingested(i: Inputs) -> DataFrame:
    """Purchases and account orders written as text files and read back as a log."""
    new_money = i.ledger.lots.filter(F.col("origin_sale_id").isNull())
    # Written, as two of the files are made of them.
    transfers = written(i.account_transfers, "transfers")
    redeemed = transfers.filter(F.col("destination").isNull()).select(
        "order_id", F.col("source").alias("account_id"), F.col("sell_date").alias("trade_date"), "lots",
        F.col("sold_shares").alias("shares"), "proceeds", "comment",
    )
    texts = (
        files.subscription_file(op.subscription_ops(new_money)),
        files.redemption_file(redeemed),
        files.transfer_file(transfers),
    )
    discard(transfers)
    return tx.read_operations(i.spark, *texts)[0]


FEED_SQL = "SELECT * FROM quote"
query("read_quote_csv_feed", QUOTE, FEED_SQL)(
    lambda i: quote_feeds.read_quote_csv_feed(i.spark, files.csv_feed(i.ledger.quotes))
)
query("read_quote_json_feed", QUOTE, FEED_SQL)(
    lambda i: quote_feeds.read_quote_json_feed(i.spark, files.json_feed(i.ledger.quotes))
)

query(
    "rejected_quotes",
    "feed isin line reason",
    """SELECT DISTINCT feed, isin, line, reason FROM quote, (VALUES
  ('csv', '1999-02-30 00:00:00.0;1,0', 'bad date'), ('csv', '1999-02-03 00:00:00.0;-', 'bad nav'),
  ('json', '{"rowDateRaw":0}', 'bad nav'), ('json', NULL, 'no quotes in the response')) AS bad(feed, line, reason)""",
)(
    lambda i: quote_feeds.rejected_csv_quotes(i.spark, files.csv_feed(i.ledger.quotes))
    .withColumn("feed", F.lit("csv"))
    .unionByName(
        quote_feeds.rejected_json_quotes(i.spark, files.json_feed(i.ledger.quotes)).withColumn("feed", F.lit("json"))
    )
)

query(
    "append_quotes",
    "isin date:d nav:n refused:i",
    f"""SELECT isin, date, CASE WHEN date > DATE '{END}' THEN nav END AS nav,
       arrivals - CASE WHEN date > DATE '{END}' THEN 1 ELSE 0 END AS refused
FROM (SELECT isin, trade_date AS date, count(*) AS arrivals,
        arg_min(CAST(CAST((2 * CAST(cost * 100 AS HUGEINT) * 10000000 + CAST(initial_shares * 100000 AS HUGEINT))
          // (2 * CAST(initial_shares * 100000 AS HUGEINT)) AS DECIMAL(38, 0)) * CAST(0.0001 AS DECIMAL(5, 4)) AS DECIMAL(12, 4)), lot_id) AS nav
      FROM lot JOIN account USING (account_id) GROUP BY isin, trade_date)""",
)(lambda i: _append_quotes(i))


def _paid_prices(i: Inputs) -> DataFrame:
    """What each lot cost a share, as quotes that arrive in the order of lots."""
    paid = F.try_divide(F.col("cost"), F.col("initial_shares"))
    return i.ledger.lots.join(i.ledger.accounts, "account_id").select(
        "isin", F.col("trade_date").alias("date"), paid.alias("nav"), "lot_id"
    )


query(
    "refused_quotes",
    "isin date:d lot_id:i nav:n reason times:i",
    f"""SELECT isin, date, lot_id, nav, CASE WHEN date <= DATE '{END}' THEN 'stored before' ELSE 'came later' END AS reason, 1 AS times
FROM (SELECT isin, trade_date AS date, lot_id,
        CAST(CAST((2 * CAST(cost * 100 AS HUGEINT) * 10000000 + CAST(initial_shares * 100000 AS HUGEINT))
          // (2 * CAST(initial_shares * 100000 AS HUGEINT)) AS DECIMAL(38, 0)) * CAST(0.0001 AS DECIMAL(5, 4)) AS DECIMAL(12, 4)) AS nav,
        row_number() OVER (PARTITION BY isin, trade_date ORDER BY lot_id) AS place
      FROM lot JOIN account USING (account_id))
WHERE date <= DATE '{END}' OR place > 1""",
)(lambda i: qt.refused_quotes(op.known_quotes(i.ledger.quotes, _date(END)), _paid_prices(i), ["lot_id"]))


def _append_quotes(i: Inputs) -> DataFrame:
    incoming = _paid_prices(i)
    known = op.known_quotes(i.ledger.quotes, _date(END))
    accepted, conflicts = qt.append_quotes(known, incoming, ["lot_id"])
    return accepted.join(conflicts, ["isin", "date"], "full_outer").withColumn(
        "refused", F.coalesce("refused", F.lit(0))
    )


UPSERT_VIEWS = """
change AS (
  SELECT isin, CASE risk % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'web' END AS feed,
         CASE WHEN risk % 2 = 0 THEN 'N' || risk END AS feed_key, risk <> 3 AS sets_key FROM fund),
judged AS (
  SELECT v.isin, v.feed AS old_feed, v.feed_key AS old_key, coalesce(c.feed, v.feed) AS feed,
         CASE WHEN c.sets_key THEN c.feed_key ELSE v.feed_key END AS feed_key
  FROM fund_view v JOIN change c USING (isin))"""
query(
    "upsert_fund_feed",
    "isin feed feed_key",
    """SELECT f.isin, j.feed, k.feed_key
FROM fund f JOIN (SELECT isin, CASE WHEN feed <> old_feed THEN feed ELSE old_feed END AS feed FROM judged) j USING (isin)
LEFT JOIN (
  SELECT feed, isin, feed_key FROM fund_feed k
  WHERE NOT EXISTS (SELECT 1 FROM judged j WHERE j.isin = k.isin AND j.feed = k.feed
                    AND (j.feed_key <> j.old_key OR j.feed_key IS NULL))
  UNION ALL SELECT feed, isin, feed_key FROM judged WHERE feed IS NOT NULL AND feed_key <> old_key) k
  ON k.feed = j.feed AND k.isin = j.isin""",
    UPSERT_VIEWS,
)(lambda i: _upsert(i))


query(
    "insert_funds",
    "kind isin name feed_key reason",
    """WITH added AS (SELECT 'N' || substr(isin, 2) AS isin, name || ' 1' AS name, feed, 'K' || risk AS feed_key FROM fund)
SELECT 'fund' AS kind, f.isin, f.name, k.feed_key, NULL AS reason FROM fund f LEFT JOIN fund_feed k USING (feed, isin)
UNION ALL SELECT 'fund', isin, name, CASE WHEN feed IS NOT NULL THEN feed_key END, NULL FROM added
UNION ALL SELECT 'refused', 'N' || substr(isin, 2), name || ' 2', NULL, 'repeated fund' FROM fund
UNION ALL SELECT 'refused', isin, name, NULL, 'known fund' FROM fund""",
)(lambda i: _insert_funds(i))


def _insert_funds(i: Inputs) -> DataFrame:
    """Every fund again, and a new fund for each one, named twice."""
    funds = i.ledger.funds.withColumn("feed_key", F.concat(F.lit("K"), "risk"))
    renamed = funds.withColumn("isin", F.concat(F.lit("N"), F.substring("isin", 2, 20)))
    new = funds.withColumn("turn", F.lit(0))
    for turn in (2, 1):
        new = new.unionByName(renamed.withColumns({"name": F.concat("name", F.lit(f" {turn}")), "turn": F.lit(turn)}))
    after, feeds, refused = stores.insert_funds(i.ledger.funds, i.ledger.fund_feeds, new, order=["turn"])
    kept = after.join(feeds, ["feed", "isin"], "left").select(F.lit("fund").alias("kind"), "isin", "name", "feed_key")
    return kept.unionByName(
        refused.select(F.lit("refused").alias("kind"), "isin", "name", "reason"), allowMissingColumns=True
    )


def _upsert(i: Inputs) -> DataFrame:
    risk = F.col("risk")
    updates = i.ledger.funds.select(
        "isin",
        F.when(risk % 3 == 0, "csv").when(risk % 3 == 1, "web").alias("feed"),
        F.when(risk % 2 == 0, F.concat(F.lit("N"), risk)).alias("feed_key"),
        (risk != 3).alias("sets_key"),
    )
    funds, feeds = stores.upsert_fund_feed(i.ledger.funds, i.ledger.fund_feeds, updates)
    return funds.select("isin", "feed").join(feeds, ["feed", "isin"], "left")


# --- streams ------------------------------------------------------------------


def _streamed(i: Inputs, batches: list[DataFrame], start) -> None:
    """Write each batch as quote files and let the stream take what is new."""
    folder, checkpoint = new_path(i.spark, "incoming"), new_path(i.spark, "stream")
    for batch in batches:
        files.append_lines(files.quote_lines(batch), folder)
        start(sq.quote_stream(i.spark, folder), checkpoint).awaitTermination()


@query("stream_backfill", FILLED, FILLED_SQL)
def _stream_backfill(i: Inputs) -> DataFrame:
    spark, quotes = i.spark, i.ledger.quotes.filter(F.col("date") > F.lit(_date(START)))
    lots, sales = op.pending(i.ledger.lots, i.ledger.sales)
    waiting = Ledger(**{**i.ledger.tables(), "lots": written(lots, "lots"), "sales": written(sales, "sales")})
    pending = sq.write_pending(waiting, new_path(spark, "pending"))
    done_lots = sq.empty_table(spark, new_path(spark, "done-lots"), LOT)
    done_sales = sq.empty_table(spark, new_path(spark, "done-sales"), SALE)
    early = F.col("date") <= F.lit(_date(END))
    _streamed(
        i,
        [quotes.filter(~early), quotes.filter(early)],
        lambda stream, checkpoint: sq.stream_backfill(stream, pending, done_lots, done_sales, checkpoint),
    )
    return filled_rows(spark.read.schema(LOT).parquet(done_lots), spark.read.schema(SALE).parquet(done_sales))


@query(
    "stream_quote_ingest",
    QUOTE,
    f"""SELECT isin, date, nav + CASE WHEN date <= DATE '{END}' THEN 0 WHEN date <= DATE '2000-12-31' THEN 1 ELSE 2 END AS nav
FROM quote""",
)
def _stream_ingest(i: Inputs) -> DataFrame:
    quotes, store = i.ledger.quotes, new_path(i.spark, "store")
    op.known_quotes(quotes, _date(END)).write.parquet(store)
    later = [
        quotes.filter(F.col("date") <= F.lit(_date("2000-12-31"))).withColumn("nav", F.col("nav") + 1),
        quotes.withColumn("nav", F.col("nav") + 2),
    ]
    _streamed(i, later, lambda stream, checkpoint: sq.stream_quote_ingest(stream, store, checkpoint))
    return i.spark.read.schema(QUOTE_TABLE).parquet(store)


@query(
    "stream_variation",
    "isin date:d nav:n variation:n",
    """SELECT isin, date, nav, round(CAST(nav AS DOUBLE) / CAST(previous AS DOUBLE) - 1, 4) * 100 AS variation
FROM (SELECT *, lag(nav) OVER (PARTITION BY isin ORDER BY date) AS previous FROM quote) WHERE previous IS NOT NULL""",
)
def _stream_variation(i: Inputs) -> DataFrame:
    quotes, output = i.ledger.quotes, new_path(i.spark, "variations")
    early = F.col("date") <= F.lit(_date(END))
    _streamed(
        i,
        [quotes.filter(early), quotes.filter(~early)],
        lambda stream, checkpoint: sq.stream_variation(stream, output, checkpoint),
    )
    return i.spark.read.parquet(output)
