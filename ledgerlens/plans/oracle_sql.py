"""Shared SQL fragments for the DuckDB oracle: the derived views, written once.

Only the base tables are registered in the oracle; each query text re-declares the views
it needs as CTEs, with the same expressions the Spark side uses.
"""

from __future__ import annotations

SALES = """sales AS (
  SELECT o.o_orderdate AS order_date,
         (round(l.l_extendedprice * 100) * (100 - round(l.l_discount * 100))) / 10000.0 AS revenue,
         p.p_name AS product, r.r_name AS region, l.l_quantity AS quantity
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey
)"""


def calendar(src: str) -> str:
    return f"""SELECT *, CAST(month("Date") AS INTEGER) AS "MonthNum", strftime("Date", '%b') AS "Month",
         'Q' || CAST(quarter("Date") AS VARCHAR) AS "Quarter",
         CAST(weekofyear("Date") AS INTEGER) AS "Week", dayname("Date") AS "Day"
  FROM {src}"""


CLEAN_SALES = SALES + """,
clean0 AS (
  SELECT order_date, CAST(order_date AS DATE) AS "Date", CAST(revenue AS DOUBLE) AS "Revenue",
         COALESCE(CAST(product AS VARCHAR), 'Unknown') AS "Product",
         COALESCE(CAST(region AS VARCHAR), 'Unknown') AS "Region",
         COALESCE(CAST(quantity AS DOUBLE), 0.0) AS "Quantity"
  FROM sales WHERE order_date IS NOT NULL
),
clean AS (""" + calendar("clean0") + "\n)"

# Text amounts/dates dirtied by o_orderkey % k; mirrors sources.tables.raw_orders.
RAW_ORDERS = """raw_orders AS (
  SELECT o_orderkey AS order_id,
    CASE WHEN o_orderkey % 9 = 0 THEN strftime(o_orderdate, '%m/%d/%Y')
         WHEN o_orderkey % 9 = 1 THEN 'bad'
         WHEN o_orderkey % 9 = 2 THEN NULL
         WHEN o_orderkey % 9 = 3 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
         ELSE strftime(o_orderdate, '%Y-%m-%d') END AS invoice_date,
    CASE WHEN o_orderkey % 10 = 0 THEN '$' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT))
         WHEN o_orderkey % 10 = 1 THEN 'Rs. ' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT))
         WHEN o_orderkey % 10 = 2 THEN '(' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || ')'
         WHEN o_orderkey % 10 = 3 THEN ''
         WHEN o_orderkey % 10 = 4 THEN NULL
         WHEN o_orderkey % 10 = 5 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '%'
         WHEN o_orderkey % 10 = 6 THEN '-$' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)
         WHEN o_orderkey % 10 = 7 THEN 'n/a'
         ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS amount,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS item,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 13 = 1 THEN '' ELSE o_orderstatus END AS market,
    CASE WHEN o_orderkey % 6 = 0 THEN '1,200' WHEN o_orderkey % 6 = 1 THEN NULL
         WHEN o_orderkey % 6 = 2 THEN 'x' ELSE CAST(o_custkey % 50 AS VARCHAR) END AS units
  FROM orders
)"""

STRICT_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

CLEAN_RAW_ORDERS = RAW_ORDERS + """,
rclean0 AS (
  SELECT order_id, invoice_date, amount, item, market, units,
    CAST(COALESCE(try_strptime(trim(invoice_date), '%Y-%m-%d'),
                  try_strptime(trim(invoice_date), '%Y-%m-%d %H:%M:%S'),
                  try_strptime(trim(invoice_date), '%Y-%m-%dT%H:%M:%S'),
                  try_strptime(trim(invoice_date), '%m/%d/%Y'),
                  try_strptime(trim(invoice_date), '%Y/%m/%d')) AS DATE) AS "Date",
    COALESCE(TRY_CAST(regexp_replace(amount, '[^0-9.\\-]', '', 'g') AS DOUBLE), 0.0) AS "Revenue",
    COALESCE(item, 'Unknown') AS "Product",
    COALESCE(market, 'Unknown') AS "Region",
    COALESCE(CASE WHEN regexp_matches(units, '""" + STRICT_NUMBER + """')
                  THEN TRY_CAST(trim(units) AS DOUBLE) END, 0.0) AS "Quantity"
  FROM raw_orders
),
rclean AS (""" + calendar('rclean0 WHERE "Date" IS NOT NULL') + "\n)"

# `events` as a sales upload, cleaned: event_time -> Date, value -> Revenue.
CLEAN_EVENTS = """eclean0 AS (
  SELECT ts AS event_time, value, event_type,
         CAST(ts AS DATE) AS "Date", COALESCE(CAST(value AS DOUBLE), 0.0) AS "Revenue",
         'Unknown' AS "Product", 'Unknown' AS "Region", 0.0 AS "Quantity"
  FROM events WHERE ts IS NOT NULL
),
eclean AS (""" + calendar("eclean0") + "\n)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
