"""ANSI SQL that gives the same results as the Spark queries on the same tables.

Number rule on both engines: shares, money and prices stay decimal, ratios are
cut to twelve decimals before they multiply, and money is rounded last. Decimal
division is written with whole numbers, since SQL engines differ there.
"""

from __future__ import annotations


def ratio(part: str, whole: str) -> str:
    """``part / whole`` of five-decimal values, rounded half up to twelve decimals."""
    a, b = (f"CAST(({x}) * 100000 AS HUGEINT)" for x in (part, whole))
    return (
        f"CAST(CAST((2 * {a} * 1000000000000 + {b}) // (2 * {b}) AS DECIMAL(38, 0))"
        " * CAST(0.000000000001 AS DECIMAL(13, 12)) AS DECIMAL(18, 12))"
    )


def shares_for(amount: str, nav: str) -> str:
    """Shares that ``amount`` buys, cut down to five decimals."""
    cents, price = f"CAST(({amount}) * 100 AS HUGEINT)", f"CAST(({nav}) * 10000 AS HUGEINT)"
    return (
        f"CAST(CAST(({cents} * 10000000) // {price} AS DECIMAL(38, 0))"
        " * CAST(0.00001 AS DECIMAL(6, 5)) AS DECIMAL(18, 5))"
    )


def money(amount: str) -> str:
    return f"CAST(round({amount}, 2) AS DECIMAL(18, 2))"


def worth(shares: str, nav: str) -> str:
    """Exact product of shares and price."""
    return f"CAST({shares} AS DECIMAL(19, 5)) * {nav}"


def scaled(amount: str, part: str) -> str:
    """Exact product of money and a ratio."""
    return f"CAST({amount} AS DECIMAL(19, 2)) * {part}"


LEDGER = f"""
numbered AS (
  SELECT l_orderkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_returnflag, l_linestatus,
         l_partkey,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey,
           l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus) AS seq
  FROM lineitem),
line AS (
  SELECT l_orderkey, seq, l_orderkey * 10000000 + seq AS lot_id,
         'FX' || lpad(CAST(l_suppkey % 10 AS VARCHAR), 10, '0') AS isin,
         CASE WHEN l_suppkey % 20 >= 10 THEN 'B1' ELSE 'B0' END AS distributor,
         o_custkey || '-FX' || lpad(CAST(l_suppkey % 10 AS VARCHAR), 10, '0') || '-'
           || CASE WHEN l_suppkey % 20 >= 10 THEN 'B1' ELSE 'B0' END AS account_id,
         CAST(l_shipdate AS DATE) AS trade_date,
         CAST(l_quantity AS DECIMAL(18, 5)) AS quantity,
         CAST(l_extendedprice AS DECIMAL(18, 2)) AS cost,
         CAST(p_retailprice AS DECIMAL(12, 4)) AS retail,
         l_returnflag AS flag, l_linestatus AS status
  FROM numbered JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
linked AS (
  SELECT *, coalesce(lag(flag) OVER w = 'A', false) AS moved_in,
         lead(trade_date) OVER w AS next_date, lead(account_id) OVER w AS next_account
  FROM line WINDOW w AS (PARTITION BY l_orderkey ORDER BY seq)),
grouped AS (
  SELECT *, sum(CASE WHEN moved_in THEN 0 ELSE 1 END)
           OVER (PARTITION BY l_orderkey ORDER BY seq ROWS UNBOUNDED PRECEDING) AS grp
  FROM linked),
chained AS MATERIALIZED (
  SELECT *, min(trade_date) OVER (PARTITION BY l_orderkey, grp) AS invest_date FROM grouped),
sold AS (
  SELECT lot_id AS sale_id, lot_id, account_id,
         CASE WHEN flag = 'A' AND next_date IS NOT NULL THEN next_date ELSE trade_date + 30 END AS trade_date,
         CASE WHEN flag = 'A' AND next_date IS NOT NULL THEN next_account ELSE '' END AS destination,
         CAST(CASE WHEN status = 'F' THEN quantity ELSE quantity * 0.5 END AS DECIMAL(18, 5)) AS shares,
         {money(worth("quantity", "retail"))} AS proceeds
  FROM chained WHERE flag IN ('A', 'R')),
ordered AS (
  SELECT *, min(sale_id) OVER (PARTITION BY account_id, trade_date, destination) AS order_id FROM sold),
fund_number AS (SELECT DISTINCT s_suppkey % 10 AS n FROM supplier),
fund AS (
  SELECT 'FX' || lpad(CAST(n AS VARCHAR), 10, '0') AS isin, 'Fund ' || n AS name,
         CASE WHEN n % 2 = 0 THEN 'F' || n END AS alias, 'M' || (n % 3) AS manager, 'EUR' AS currency,
         1 + n % 7 AS risk, CASE n % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' END AS feed, n <> 9 AS active
  FROM fund_number),
feed AS (SELECT DISTINCT feed FROM fund WHERE feed IS NOT NULL),
fund_feed AS (
  SELECT CASE n % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' END AS feed,
         'FX' || lpad(CAST(n AS VARCHAR), 10, '0') AS isin, 'K' || n AS feed_key
  FROM fund_number WHERE n % 3 <> 2 AND n % 2 = 0),
account AS (SELECT DISTINCT account_id, isin, distributor FROM chained),
lot AS MATERIALIZED (
  SELECT lot_id, account_id, invest_date, trade_date, quantity AS initial_shares, cost,
         CASE WHEN moved_in THEN lot_id - 1 END AS origin_sale_id
  FROM chained),
sale_order AS (
  SELECT DISTINCT order_id, trade_date, CASE WHEN destination = '' THEN 'redemption' ELSE 'transfer' END AS comment
  FROM ordered),
sale AS (SELECT sale_id, order_id, lot_id, shares, proceeds FROM ordered),
quote AS MATERIALIZED (
  SELECT isin, trade_date AS date, CAST(max(retail) AS DECIMAL(12, 4)) AS nav
  FROM chained GROUP BY isin, trade_date)"""

VIEWS = f"""
fund_view AS (
  SELECT isin, name, coalesce(alias, name) AS alias, manager, currency, risk, feed,
         coalesce(feed_key, isin) AS feed_key, active
  FROM fund LEFT JOIN fund_feed USING (feed, isin)),
sold_by_lot AS (SELECT lot_id, CAST(sum(shares) AS DECIMAL(18, 5)) AS sold FROM sale GROUP BY lot_id),
open_lot AS (
  SELECT lot_id, account_id, invest_date, trade_date, initial_shares,
         CAST(initial_shares - coalesce(sold, 0) AS DECIMAL(18, 5)) AS shares,
         {money(scaled("cost", "(1 - " + ratio("coalesce(sold, CAST(0 AS DECIMAL(18, 5)))", "initial_shares") + ")"))} AS cost,
         origin_sale_id
  FROM lot LEFT JOIN sold_by_lot USING (lot_id)),
latest AS (SELECT isin, max(date) AS date, arg_max(nav, date) AS nav FROM quote GROUP BY isin),
sale_view AS (
  SELECT sale_id, order_id, lot_id, trade_date, shares, proceeds, comment FROM sale JOIN sale_order USING (order_id)),
transfer_view AS (
  SELECT sale_id, order_id, v.lot_id, v.trade_date AS sell_date, v.shares AS sold_shares, proceeds,
         c.account_id AS destination, c.trade_date AS buy_date, c.initial_shares AS bought_shares, comment
  FROM sale_view v LEFT JOIN lot c ON c.origin_sale_id = v.sale_id),
account_sale AS (
  SELECT order_id, account_id, v.trade_date, count(*) AS lots, sum(v.shares) AS shares,
         sum(proceeds) AS proceeds, comment
  FROM sale_view v JOIN lot USING (lot_id) GROUP BY order_id, account_id, v.trade_date, comment),
account_transfer AS (
  SELECT order_id, account_id AS source, sell_date, destination, buy_date, count(*) AS lots,
         sum(sold_shares) AS sold_shares, sum(proceeds) AS proceeds, sum(bought_shares) AS bought_shares, comment
  FROM transfer_view JOIN lot USING (lot_id)
  GROUP BY order_id, account_id, sell_date, destination, buy_date, comment),
switch AS (
  SELECT c.lot_id, c.trade_date AS buy_date, a2.isin
  FROM lot p JOIN sale s ON s.lot_id = p.lot_id JOIN lot c ON c.origin_sale_id = s.sale_id
  JOIN account a1 ON a1.account_id = p.account_id JOIN account a2 ON a2.account_id = c.account_id
  WHERE a1.isin = a2.isin),
grouped_position AS (
  SELECT isin, distributor, sum(cost) AS capital, CAST(sum(shares) AS DECIMAL(24, 5)) AS shares
  FROM open_lot JOIN account USING (account_id) GROUP BY isin, distributor),
position AS (
  SELECT isin, distributor, capital, shares, date, nav, shares * nav AS worth
  FROM grouped_position LEFT JOIN latest USING (isin)),
portfolio AS (
  SELECT isin, distributor, capital, shares,
         round(CAST(worth AS DOUBLE) / CAST(sum(worth) OVER () AS DOUBLE), 4) AS weight,
         date, nav, round(worth, 2) AS valuation,
         round(CAST(worth AS DOUBLE) / nullif(CAST(capital AS DOUBLE), 0) - 1, 4) AS gain
  FROM position),
sold_lot AS MATERIALIZED (
  SELECT s.sale_id, s.order_id, s.trade_date AS end_date, s.shares, s.proceeds, l.lot_id, l.account_id, a.isin,
         l.invest_date, l.trade_date, l.cost, l.origin_sale_id,
         {ratio("s.shares", "l.initial_shares")} AS part
  FROM sale_view s JOIN lot l USING (lot_id) JOIN account a USING (account_id)),
chain AS (
  (SELECT lot_id AS terminal_lot, CAST(0 AS BIGINT) AS order_id, 0 AS hop, lot_id, account_id, isin,
          invest_date, trade_date, l.date AS end_date,
          {ratio("shares", "initial_shares")} AS fraction,
          cost, l.nav, shares, {money(worth("shares", "l.nav"))} AS proceeds, origin_sale_id
   FROM open_lot JOIN account USING (account_id) LEFT JOIN latest l USING (isin) WHERE shares > 0
   UNION ALL
   SELECT lot_id, order_id, 0, lot_id, account_id, isin, invest_date, trade_date, end_date, part,
          {money(scaled("cost", "part"))}, NULL, shares, proceeds, origin_sale_id
   FROM sold_lot WHERE NOT EXISTS (SELECT 1 FROM lot c WHERE c.origin_sale_id = sold_lot.sale_id))
  UNION ALL
  SELECT c.terminal_lot, c.order_id, c.hop + 1, s.lot_id, s.account_id, s.isin, s.invest_date, s.trade_date,
         s.end_date, CAST(CAST(c.fraction AS DECIMAL(19, 12)) * s.part AS DECIMAL(18, 12)),
         {money(scaled("s.cost", "CAST(CAST(c.fraction AS DECIMAL(19, 12)) * s.part AS DECIMAL(18, 12))"))},
         NULL, CAST(round(CAST(s.shares AS DECIMAL(19, 5)) * c.fraction, 4) AS DECIMAL(18, 5)),
         {money(scaled("s.proceeds", "c.fraction"))}, s.origin_sale_id
  FROM chain c JOIN sold_lot s ON c.origin_sale_id = s.sale_id),
lineage AS MATERIALIZED (
  SELECT *, first_value(lot_id) OVER w AS origin_lot, first_value(cost) OVER w AS capital
  FROM chain
  WINDOW w AS (PARTITION BY terminal_lot, order_id ORDER BY trade_date, hop DESC)),
gains AS (
  SELECT terminal_lot, order_id, account_id, isin, origin_lot, invest_date, end_date, capital, shares, proceeds,
         proceeds - capital AS gain
  FROM lineage WHERE terminal_lot = lot_id)"""


def between(start: str | None, end: str | None) -> str:
    """Views behind the portfolio between two dates."""
    lo = f"greatest(trade_date, DATE '{start}')" if start else "trade_date"
    hi = f"least(end_date, DATE '{end}')" if end else "end_date"
    switched = f"WHERE buy_date >= DATE '{start}'" if start else ""

    def based(purchase: str) -> str:
        cost = f"CAST({purchase}.cost AS DECIMAL(31, 9))"
        if not start:
            return cost
        at_start = f"CAST({worth('o.shares', 'o.first_nav')} AS DECIMAL(31, 9))"
        return f"CASE WHEN {purchase}.trade_date < DATE '{start}' THEN {at_start} ELSE {cost} END"

    return f"""
held AS (
  SELECT terminal_lot, lot_id, account_id, isin, trade_date, shares, cost, {lo} AS lo, {hi} AS hi
  FROM lineage WHERE order_id = 0 AND end_date IS NOT NULL),
progress AS (
  SELECT h.terminal_lot, h.lot_id, h.account_id, h.isin, h.trade_date, h.shares, h.cost,
         min(q.date) AS first_date, arg_min(q.nav, q.date) AS first_nav,
         max(q.date) AS date, arg_max(q.nav, q.date) AS nav
  FROM held h JOIN quote q ON q.isin = h.isin AND q.date BETWEEN h.lo AND h.hi
  GROUP BY h.terminal_lot, h.lot_id, h.account_id, h.isin, h.trade_date, h.shares, h.cost),
opening AS (
  SELECT * FROM progress QUALIFY row_number() OVER (
    PARTITION BY terminal_lot ORDER BY first_date, trade_date, lot_id) = 1),
closing AS (
  SELECT * FROM progress QUALIFY row_number() OVER (
    PARTITION BY terminal_lot ORDER BY date DESC, trade_date DESC, lot_id DESC) = 1),
bought AS (
  SELECT * FROM progress WHERE lot_id NOT IN (SELECT lot_id FROM switch {switched}) QUALIFY row_number() OVER (
    PARTITION BY terminal_lot ORDER BY date DESC, trade_date DESC, lot_id DESC) = 1),
chain_value AS (
  SELECT o.terminal_lot, c.account_id, c.date, c.nav, c.shares,
         {based("o")} AS initial, {based("b")} AS capital
  FROM opening o JOIN closing c USING (terminal_lot) JOIN bought b USING (terminal_lot)),
account_value AS (
  SELECT account_id, sum(initial) AS initial, sum(capital) AS capital, max(date) AS date,
         arg_max(nav, date) AS nav, CAST(sum(shares) AS DECIMAL(24, 5)) AS shares
  FROM chain_value GROUP BY account_id),
portfolio_between AS (
  SELECT account_id, isin, distributor, round(capital - initial, 2) AS prior_gain, capital, shares,
         round(CAST(shares * nav AS DOUBLE) / CAST(sum(shares * nav) OVER () AS DOUBLE), 4) AS weight, date, nav,
         round(shares * nav, 2) AS valuation,
         round(CAST(shares * nav AS DOUBLE) / nullif(CAST(capital AS DOUBLE), 0) - 1, 4) AS gain
  FROM account_value JOIN account USING (account_id))"""


def evolution(period: str) -> str:
    """Views behind the evolution by weeks or months over the whole range, by the plain bucket ranges."""
    step = {"months": "to_months(CAST({} AS INTEGER))", "weeks": "to_days(CAST(7 * ({}) AS INTEGER))"}[period]
    before, after = step.format("k - 1"), step.format("k")
    return f"""
begun AS (SELECT min(trade_date) AS begin FROM lot),
bucket AS MATERIALIZED (
  SELECT k, CAST(begin + {before} AS DATE) AS inf, CAST(begin + {after} AS DATE) AS sup
  FROM begun, range(0, 10000) r(k)
  WHERE k = 0 OR begin + {before} <= DATE '2001-10-21'),
sample AS MATERIALIZED (
  SELECT isin, max(date) AS date, arg_max(nav, date) AS nav
  FROM quote JOIN bucket ON date > inf AND date <= sup GROUP BY isin, k),
point AS MATERIALIZED (
  SELECT h.terminal_lot, h.order_id, h.lot_id, h.trade_date, h.end_date, h.shares, h.isin,
         h.trade_date AS date, CAST(h.cost AS DECIMAL(31, 9)) AS value
  FROM lineage h
  WHERE h.end_date IS NOT NULL AND h.invest_date = h.trade_date
    AND h.trade_date >= (SELECT begin FROM begun)
    AND NOT EXISTS (SELECT 1 FROM sample s WHERE s.isin = h.isin AND s.date = h.trade_date)
  UNION ALL
  SELECT h.terminal_lot, h.order_id, h.lot_id, h.trade_date, h.end_date, h.shares, h.isin, s.date,
         CAST({worth("h.shares", "s.nav")} AS DECIMAL(31, 9))
  FROM lineage h JOIN sample s ON s.isin = h.isin AND s.date BETWEEN h.trade_date AND h.end_date),
start_point AS MATERIALIZED (
  SELECT terminal_lot, order_id, value AS cost FROM point QUALIFY row_number() OVER (
    PARTITION BY terminal_lot, order_id ORDER BY date, trade_date, lot_id) = 1),
evolution AS (
  SELECT '{period}' AS period, terminal_lot, order_id, lot_id, s.cost, trade_date, end_date, shares, isin, date, value
  FROM point JOIN start_point s USING (terminal_lot, order_id)
  UNION ALL
  SELECT '{period}', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, sup, NULL FROM bucket)"""


# How a result column leaves either engine: number, date, whole number or as is.
KINDS = {"n": "DOUBLE", "d": "VARCHAR", "i": "BIGINT", "b": "BOOLEAN", "s": "VARCHAR"}


def columns_of(spec: str) -> list[tuple[str, str]]:
    """Parse ``"isin date:d nav:n"`` into names and kinds; plain names are text."""
    return [(name, kind or "s") for name, _, kind in (item.partition(":") for item in spec.split())]


def statement(select: str, spec: str, *views: str) -> str:
    """One SQL statement over the raw tables, with the result columns cast."""
    columns = ", ".join(f'CAST("{name}" AS {KINDS[kind]}) AS "{name}"' for name, kind in columns_of(spec))
    ctes = ",".join([LEDGER, VIEWS, *views])
    return f"WITH RECURSIVE {ctes}\nSELECT {columns} FROM (\n{select}\n) AS result"
