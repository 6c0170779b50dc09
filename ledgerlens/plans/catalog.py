"""Every registered query, each with its DuckDB oracle when SQL can express it.

All queries read the driver tables (or views Spark derives from them) in full.
Compared doubles are rounded to 8 significant digits (`registry.rnd`, written identically
in the SQL): revenue values are exact multiples of 1e-4, so row values agree bit for bit,
and sums differ only by float noise far below that granularity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import kpi as K
from ..operators import series as S
from ..operators import schema_map as M
from ..sources import tables as TB
from .kpi_sql import kpi_ctes
from .oracle_sql import CLEAN_EVENTS, CLEAN_RAW_ORDERS, CLEAN_SALES, RAW_ORDERS, with_
from .registry import query, rnd_sig, rnd_sig_sql, rnd_sql, rounded

R = 4  # legacy digits argument; rounding is by significant digits (registry.COMPARE_SIG)


def clean_sales_view(spark: SparkSession, sf: str) -> DataFrame:
    return C.clean_sales(TB.sales(spark, sf))[0]


def clean_raw_orders(spark: SparkSession, sf: str) -> DataFrame:
    return C.clean_sales(TB.raw_orders(spark, sf))[0]


def clean_events(spark: SparkSession, sf: str) -> DataFrame:
    return C.clean_sales(TB.events_sales(spark, sf))[0]


# ---------------------------------------------------------------- schema mapping

def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    return M.schema_catalog(spark, {t: TB.table(spark, sf, t) for t in TB.TABLES})


_TABLE_LIST = ", ".join(f"'{t}'" for t in TB.TABLES)
_CATALOG_SQL = f"""catalog AS (
  SELECT table_name, CAST(ordinal_position - 1 AS INTEGER) AS pos, column_name
  FROM information_schema.columns WHERE table_name IN ({_TABLE_LIST})
)"""
_NORM = "trim(regexp_replace(lower(trim({c})), '[^a-z0-9]+', '_', 'g'), '_')"


@query("normalize_headers", oracle=with_(_CATALOG_SQL) + f"""
SELECT table_name, pos, column_name, {_NORM.format(c='column_name')} AS normalized FROM catalog""")
def q_normalize_headers(spark, sf):
    return M.normalize_headers(_catalog(spark, sf))


_KW_VALUES = ", ".join(f"('{r}', '{k}')" for r, kws in M.ROLE_KEYWORDS.items() for k in kws)


@query("detect_roles", oracle=with_(_CATALOG_SQL, f"""kw AS (SELECT * FROM (VALUES {_KW_VALUES}) v(role, keyword))""",
                                    f"""hits AS (
  SELECT c.table_name, k.role, arg_min(c.column_name, c.pos) AS column_name
  FROM catalog c JOIN kw k ON contains({_NORM.format(c='c.column_name')}, {_NORM.format(c='k.keyword')})
  GROUP BY 1, 2)""") + """
SELECT t.table_name,
  max(CASE WHEN role = 'date_col' THEN column_name END) AS date_col,
  max(CASE WHEN role = 'revenue_col' THEN column_name END) AS revenue_col,
  max(CASE WHEN role = 'product_col' THEN column_name END) AS product_col,
  max(CASE WHEN role = 'region_col' THEN column_name END) AS region_col,
  max(CASE WHEN role = 'quantity_col' THEN column_name END) AS quantity_col
FROM (SELECT DISTINCT table_name FROM catalog) t LEFT JOIN hits h USING (table_name)
GROUP BY t.table_name""")
def q_detect_roles(spark, sf):
    return M.detect_roles_catalog(_catalog(spark, sf))


# ---------------------------------------------------------------- cleaning

@query("parse_amounts", oracle=with_(RAW_ORDERS) + """
SELECT order_id, amount, """ + rnd_sql('''TRY_CAST(regexp_replace(amount, '[^0-9.\\-]', '', 'g') AS DOUBLE)''') + """ AS amount_value
FROM raw_orders""")
def q_parse_amounts(spark, sf):
    from ..functions.numeric import parse_amount
    r = TB.raw_orders(spark, sf)
    return rounded(r.select("order_id", "amount", parse_amount(F.col("amount")).alias("amount_value")), R)


@query("parse_dates", oracle=with_(RAW_ORDERS) + """
SELECT order_id, invoice_date,
  CAST(COALESCE(try_strptime(trim(invoice_date), '%Y-%m-%d'),
                try_strptime(trim(invoice_date), '%Y-%m-%d %H:%M:%S'),
                try_strptime(trim(invoice_date), '%Y-%m-%dT%H:%M:%S'),
                try_strptime(trim(invoice_date), '%m/%d/%Y'),
                try_strptime(trim(invoice_date), '%Y/%m/%d')) AS DATE) AS parsed_date
FROM raw_orders""")
def q_parse_dates(spark, sf):
    from ..functions.dates import to_day
    r = TB.raw_orders(spark, sf)
    return r.select("order_id", "invoice_date",
                    to_day(F.col("invoice_date"), r.schema["invoice_date"].dataType).alias("parsed_date"))


@query("clean_sales", oracle=with_(CLEAN_RAW_ORDERS) + """
SELECT order_id, invoice_date, amount, item, market, units, "Date", """ + rnd_sql('''"Revenue"''') + """ AS "Revenue",
       "Product", "Region", """ + rnd_sql('''"Quantity"''') + """ AS "Quantity", "MonthNum", "Month", "Quarter", "Week", "Day"
FROM rclean""")
def q_clean_sales(spark, sf):
    return rounded(clean_raw_orders(spark, sf), R)


@query("clean_sales_view", oracle=with_(CLEAN_SALES) + """
SELECT order_date, "Date", """ + rnd_sql('''"Revenue"''') + """ AS "Revenue", "Product", "Region",
       """ + rnd_sql('''"Quantity"''') + """ AS "Quantity", "MonthNum", "Month", "Quarter", "Week", "Day"
FROM clean""")
def q_clean_sales_view(spark, sf):
    return rounded(clean_sales_view(spark, sf), R)


@query("date_fallback", oracle="""
WITH c AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS idx, count(*) OVER () AS n FROM customer),
d AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment,
             CAST(DATE '2024-12-31' - CAST(n - 1 - idx AS INTEGER) AS DATE) AS "Date",
             CAST(c_custkey AS DOUBLE) AS "Revenue", c_name AS "Product", 'Unknown' AS "Region",
             CAST(0.0 AS DOUBLE) AS "Quantity" FROM c)
""" + """SELECT c_custkey, c_name, c_nationkey, """ + rnd_sql('''c_acctbal''') + """ AS c_acctbal, c_mktsegment, "Date",
       "Revenue", "Product", "Region", "Quantity",
       CAST(month("Date") AS INTEGER) AS "MonthNum", strftime("Date", '%b') AS "Month",
       'Q' || CAST(quarter("Date") AS VARCHAR) AS "Quarter", CAST(weekofyear("Date") AS INTEGER) AS "Week",
       dayname("Date") AS "Day"
FROM d""")
def q_date_fallback(spark, sf):
    out, _ = C.clean_sales(TB.table(spark, sf, "customer"), as_of="2024-12-31", order_by=["c_custkey"])
    return rounded(out, R)


@query("calendar_columns", oracle="""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS "Date", CAST(month(o_orderdate) AS INTEGER) AS "MonthNum",
       strftime(o_orderdate, '%b') AS "Month", 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS "Quarter",
       CAST(weekofyear(o_orderdate) AS INTEGER) AS "Week", dayname(o_orderdate) AS "Day"
FROM orders""")
def q_calendar_columns(spark, sf):
    from ..functions.dates import calendar_columns
    o = TB.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("Date"))
    return o.withColumns(calendar_columns(F.col("Date")))


# ---------------------------------------------------------------- filters

@query("segment_filter", oracle=with_(CLEAN_SALES) + """
SELECT "Date", """ + rnd_sql('''"Revenue"''') + """ AS "Revenue", "Product", "Region", "Quarter", "Day"
FROM clean WHERE CAST("Region" AS VARCHAR) = 'EUROPE'""")
def q_segment_filter(spark, sf):
    df = C.segment_filter(clean_sales_view(spark, sf), "Region", "EUROPE")
    return rounded(df.select("Date", "Revenue", "Product", "Region", "Quarter", "Day"), R)


@query("segment_filter_fallback", oracle=with_(CLEAN_SALES) + """
SELECT "Date", """ + rnd_sql('''"Revenue"''') + """ AS "Revenue", "Product", "Region"
FROM clean WHERE CAST("Region" AS VARCHAR) = 'ATLANTIS'
UNION ALL
SELECT "Date", """ + rnd_sql('''"Revenue"''') + """ AS "Revenue", "Product", "Region"
FROM clean WHERE NOT EXISTS (SELECT 1 FROM clean WHERE CAST("Region" AS VARCHAR) = 'ATLANTIS')""")
def q_segment_filter_fallback(spark, sf):
    df = C.filter_or_all(clean_sales_view(spark, sf), "Region", "ATLANTIS")
    return rounded(df.select("Date", "Revenue", "Product", "Region"), R)


@query("filter_values", oracle=with_(CLEAN_SALES) + """
SELECT f AS filter_by, 'All' AS value, true AS is_all FROM (VALUES ('Product'), ('Region'), ('Quarter'), ('Day')) v(f)
UNION ALL SELECT DISTINCT 'Product', CAST("Product" AS VARCHAR), false FROM clean WHERE "Product" IS NOT NULL
UNION ALL SELECT DISTINCT 'Region', CAST("Region" AS VARCHAR), false FROM clean WHERE "Region" IS NOT NULL
UNION ALL SELECT DISTINCT 'Quarter', CAST("Quarter" AS VARCHAR), false FROM clean WHERE "Quarter" IS NOT NULL
UNION ALL SELECT DISTINCT 'Day', CAST("Day" AS VARCHAR), false FROM clean WHERE "Day" IS NOT NULL""")
def q_filter_values(spark, sf):
    return C.filter_values_all(clean_sales_view(spark, sf))


# ---------------------------------------------------------------- daily series

@query("daily_revenue", oracle=with_(CLEAN_SALES) + """
SELECT "Date" AS ds, """ + rnd_sql('''sum("Revenue")''') + """ AS y FROM clean GROUP BY "Date\"""")
def q_daily_revenue(spark, sf):
    return rounded(S.daily(clean_sales_view(spark, sf)), R)


def _gapfill_sql(ctes: str, daily_sql: str, keys: list[str], round_y: bool = True) -> str:
    """Oracle for J1: per-segment calendar from min to max day, left-joined to the daily sums.
    `round_y=False` keeps exact values when the result feeds further SQL."""
    kq = [f'"{c}"' for c in keys]
    k = "".join(f"{c}, " for c in kq)
    group = ("GROUP BY " + ", ".join(kq)) if keys else ""
    on = "".join(f" AND c.{c} = d.{c}" for c in kq)
    y = rnd_sql("COALESCE(d.y, 0.0)") if round_y else "COALESCE(d.y, 0.0)"
    return with_(ctes, f"daily AS ({daily_sql})", f"""bounds AS (SELECT {k}min(ds) AS lo, max(ds) AS hi FROM daily {group})""",
                 f"""cal AS (SELECT {k}CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ds, lo,
               CAST(datediff('day', lo, hi) + 1 AS INTEGER) AS n_days FROM bounds)""") + f"""
SELECT {"".join(f"c.{c}, " for c in kq)}c.ds, {y} AS y,
       CAST(datediff('day', c.lo, c.ds) AS INTEGER) AS t, c.n_days
FROM cal c LEFT JOIN daily d ON c.ds = d.ds{on}"""


@query("daily_gapfilled", oracle=_gapfill_sql(CLEAN_SALES, 'SELECT "Date" AS ds, sum("Revenue") AS y FROM clean GROUP BY 1', []))
def q_daily_gapfilled(spark, sf):
    return rounded(S.gap_fill(S.daily(clean_sales_view(spark, sf))), R)


@query("daily_by_region", oracle=_gapfill_sql(
    CLEAN_SALES, 'SELECT "Region", "Date" AS ds, sum("Revenue") AS y FROM clean GROUP BY 1, 2', ["Region"]))
def q_daily_by_region(spark, sf):
    return rounded(S.gap_fill(S.daily(clean_sales_view(spark, sf), ["Region"]), ["Region"]), R)


@query("daily_events", oracle=_gapfill_sql(
    "ev AS (SELECT * FROM events)",
    "SELECT event_type, CAST(ts AS DATE) AS ds, sum(COALESCE(value, 0.0)) AS y FROM events "
    "WHERE ts IS NOT NULL GROUP BY 1, 2", ["event_type"]))
def q_daily_events(spark, sf):
    ev = TB.table(spark, sf, "events")
    return rounded(S.prepare_daily_series(ev, ["event_type"], date_col="ts", value_col="value"), R)


# ---------------------------------------------------------------- KPIs

def _kpi_sql(src_ctes: str, src: str, keys: list[str], cols: list[str], has_profit: bool = False) -> str:
    ctes, k = kpi_ctes(src, keys, has_profit)
    sel = []
    for c in [f'"{x}"' for x in keys] + cols:
        d = _KPI_DIGITS.get(c, R)
        sel.append(c if c.startswith('"') or c in _KPI_NON_DOUBLE else f"{rnd_sql(c, d)} AS {c}")
    return f"WITH {src_ctes},\n{ctes}\nSELECT {', '.join(sel)} FROM kpi"


# profit (revenue × 0.35) and averages (sum / n) sit on ties at 4 decimals far more often than at 2
_KPI_DIGITS = {"profit": 2, "avg_revenue": 2}
_KPI_NON_DOUBLE = {"total_records", "unique_products", "unique_regions", "top_product", "weak_product",
                   "top_region", "weak_region", "n_days"}


def _kpi_q(spark, sf, keys, cols, src=clean_sales_view):
    out = K.calculate_kpis(src(spark, sf), keys)
    return rounded(out.select(*keys, *cols), R, _KPI_DIGITS)


_TOTALS = ["total_revenue", "avg_revenue", "total_records", "profit", "margin_pct", "unique_products",
           "unique_regions"]
_TOPWEAK = ["top_product", "top_product_revenue", "top_product_share", "weak_product",
            "weak_product_revenue", "weak_product_share", "top_region", "top_region_revenue",
            "top_region_share", "weak_region", "weak_region_revenue", "weak_region_share"]
_ALL = K.KPI_FIELDS


@query("kpi_totals", oracle=_kpi_sql(CLEAN_SALES, "clean", [], _TOTALS))
def q_kpi_totals(spark, sf):
    return _kpi_q(spark, sf, [], _TOTALS)


@query("kpi_growth", oracle=_kpi_sql(CLEAN_SALES, "clean", ["Region"], ["growth_pct", "n_days"]))
def q_kpi_growth(spark, sf):
    return _kpi_q(spark, sf, ["Region"], ["growth_pct", "n_days"])


@query("kpi_volatility", oracle=_kpi_sql(CLEAN_SALES, "clean", ["Product"], ["volatility_pct", "avg_revenue"]))
def q_kpi_volatility(spark, sf):
    return _kpi_q(spark, sf, ["Product"], ["volatility_pct", "avg_revenue"])


@query("kpi_top_weak", oracle=_kpi_sql(CLEAN_SALES, "clean", [], _TOPWEAK))
def q_kpi_top_weak(spark, sf):
    return _kpi_q(spark, sf, [], _TOPWEAK)


@query("kpi_snapshot", oracle=_kpi_sql(CLEAN_SALES, "clean", [], _ALL))
def q_kpi_snapshot(spark, sf):
    return _kpi_q(spark, sf, [], _ALL)


@query("kpi_by_region", oracle=_kpi_sql(CLEAN_SALES, "clean", ["Region"], _ALL))
def q_kpi_by_region(spark, sf):
    return _kpi_q(spark, sf, ["Region"], _ALL)


@query("kpi_by_product_region", oracle=_kpi_sql(CLEAN_SALES, "clean", ["Product", "Region"], _ALL))
def q_kpi_by_product_region(spark, sf):
    return _kpi_q(spark, sf, ["Product", "Region"], _ALL)


_SALES_PROFIT_CTE = CLEAN_SALES.replace(
    'COALESCE(CAST(quantity AS DOUBLE), 0.0) AS "Quantity"',
    'COALESCE(CAST(quantity AS DOUBLE), 0.0) AS "Quantity", revenue * 0.34 AS "Profit"')


@query("kpi_profit_actual", oracle=_kpi_sql(_SALES_PROFIT_CTE, "clean", ["Region"], ["total_revenue", "profit", "margin_pct"], True))
def q_kpi_profit_actual(spark, sf):
    out = K.calculate_kpis(C.clean_sales(TB.sales_profit(spark, sf))[0], ["Region"])
    return rounded(out.select("Region", "total_revenue", "profit", "margin_pct"), R, _KPI_DIGITS)


@query("growth_short_series", oracle=_kpi_sql(CLEAN_EVENTS, "eclean", [], ["growth_pct", "n_days", "total_revenue"]))
def q_growth_short_series(spark, sf):
    return _kpi_q(spark, sf, [], ["growth_pct", "n_days", "total_revenue"], src=clean_events)


# ---------------------------------------------------------------- rollups

from ..functions.dates import MONTHS, WEEKDAYS  # noqa: E402
from ..operators import rollups as RU  # noqa: E402
from ..operators import anomaly as AN  # noqa: E402
from .oracle_sql import STRICT_NUMBER  # noqa: E402

_WEEKDAY_VALUES = ", ".join(f"({i}, '{d}')" for i, d in enumerate(WEEKDAYS))


@query("rollup_any", oracle=with_(CLEAN_SALES) + """
SELECT "Quarter", """ + rnd_sql('sum(COALESCE("Quantity", 0.0))') + """ AS "Quantity",
       CAST(list_position(['Q1', 'Q2', 'Q3', 'Q4'], "Quarter") AS BIGINT) AS sort_pos
FROM clean WHERE "Quarter" IS NOT NULL GROUP BY "Quarter\"""")
def q_rollup_any(spark, sf):
    return rounded(RU.chart_rollup(clean_sales_view(spark, sf), "Quarter", "Quantity"), R)


@query("rollup_text_measure", oracle=with_(CLEAN_RAW_ORDERS) + """
SELECT market, """ + rnd_sql(
    "sum(COALESCE(CASE WHEN regexp_matches(units, '" + STRICT_NUMBER + "') THEN TRY_CAST(trim(units) AS DOUBLE) END, 0.0))")
       + """ AS units
FROM rclean WHERE market IS NOT NULL GROUP BY market""")
def q_rollup_text_measure(spark, sf):
    return rounded(RU.chart_rollup(clean_raw_orders(spark, sf), "market", "units"), R)


@query("trend_daily", oracle=with_(CLEAN_SALES) + """
SELECT "Region", "Date", """ + rnd_sql('sum("Revenue")') + """ AS "Revenue" FROM clean GROUP BY 1, 2""")
def q_trend_daily(spark, sf):
    return rounded(RU.trend_daily(clean_sales_view(spark, sf), ["Region"]), R)


@query("monthly", oracle=with_(CLEAN_SALES) + """
SELECT "MonthNum", "Month", """ + rnd_sql('sum("Revenue")') + """ AS "Revenue" FROM clean GROUP BY 1, 2""")
def q_monthly(spark, sf):
    return rounded(RU.monthly(clean_sales_view(spark, sf)), R)


@query("weekday", oracle=with_(CLEAN_SALES, f"dom AS (SELECT * FROM (VALUES {_WEEKDAY_VALUES}) v(day_pos, \"Day\"))",
                               'agg AS (SELECT "Day", sum("Revenue") AS rev FROM clean GROUP BY 1)') + """
SELECT CAST(d.day_pos AS INTEGER) AS day_pos, d."Day", """ + rnd_sql("COALESCE(a.rev, 0.0)") + """ AS "Revenue"
FROM dom d LEFT JOIN agg a USING ("Day")""")
def q_weekday(spark, sf):
    return rounded(RU.weekday(clean_sales_view(spark, sf)), R)


@query("weekday_by_region", oracle=with_(
    CLEAN_SALES, f"dom AS (SELECT * FROM (VALUES {_WEEKDAY_VALUES}) v(day_pos, \"Day\"))",
    'segs AS (SELECT DISTINCT "Region" FROM clean)',
    'agg AS (SELECT "Region", "Day", sum("Revenue") AS rev FROM clean GROUP BY 1, 2)') + """
SELECT s."Region", CAST(d.day_pos AS INTEGER) AS day_pos, d."Day", """ + rnd_sql("COALESCE(a.rev, 0.0)") + """ AS "Revenue"
FROM segs s CROSS JOIN dom d LEFT JOIN agg a ON a."Region" = s."Region" AND a."Day" = d."Day\"""")
def q_weekday_by_region(spark, sf):
    return rounded(RU.weekday(clean_sales_view(spark, sf), ["Region"]), R)


@query("top_products", oracle=with_(CLEAN_SALES) + """
SELECT "Product", """ + rnd_sql("rev") + """ AS "Revenue", CAST(rk AS INTEGER) AS rank FROM (
  SELECT "Product", sum("Revenue") AS rev, row_number() OVER (ORDER BY sum("Revenue") DESC, "Product") AS rk
  FROM clean GROUP BY 1) WHERE rk <= 6""")
def q_top_products(spark, sf):
    return rounded(RU.top_products(clean_sales_view(spark, sf)), R)


@query("top_products_by_region", oracle=with_(CLEAN_SALES) + """
SELECT "Region", "Product", """ + rnd_sql("rev") + """ AS "Revenue", CAST(rk AS INTEGER) AS rank FROM (
  SELECT "Region", "Product", sum("Revenue") AS rev,
         row_number() OVER (PARTITION BY "Region" ORDER BY sum("Revenue") DESC, "Product") AS rk
  FROM clean GROUP BY 1, 2) WHERE rk <= 6""")
def q_top_products_by_region(spark, sf):
    return rounded(RU.top_products(clean_sales_view(spark, sf), ["Region"]), R)


@query("region_revenue", oracle=with_(CLEAN_SALES) + """
SELECT "Region", """ + rnd_sql('sum("Revenue")') + """ AS "Revenue" FROM clean GROUP BY 1""")
def q_region_revenue(spark, sf):
    return rounded(RU.region_revenue(clean_sales_view(spark, sf)), R)


@query("product_region", oracle=with_(CLEAN_SALES, """perf AS (
  SELECT "Product", "Region", sum("Revenue") AS rev, sum("Revenue" * 0.35) AS profit, sum("Quantity") AS qty
  FROM clean GROUP BY 1, 2)""", "mx AS (SELECT max(rev) AS m FROM perf)") + """
SELECT "Product", "Region", """ + rnd_sql("rev") + """ AS "Revenue", """ + rnd_sql("profit", 2) + """ AS "Profit",
       """ + rnd_sql("qty") + """ AS "Quantity",
       """ + rnd_sql("least(22.0, greatest(8.0, rev / (CASE WHEN m > 0 THEN m ELSE 1.0 END) * 22.0))") + """ AS "PointSize"
FROM perf, mx""")
def q_product_region(spark, sf):
    return rounded(RU.product_region(clean_sales_view(spark, sf)), R, {"Profit": 2})


_MONTH_COLS = ", ".join(
    f'{rnd_sql("COALESCE(h.m_" + m + ", 0.0)")} AS "{m}"' for m in MONTHS)
_MONTH_SUMS = ", ".join(f"""sum(CASE WHEN "Month" = '{m}' THEN "Revenue" END) AS m_{m}""" for m in MONTHS)


@query("heatmap", oracle=with_(CLEAN_SALES, f"dom AS (SELECT * FROM (VALUES {_WEEKDAY_VALUES}) v(day_pos, \"Day\"))",
                               f'h AS (SELECT "Day", {_MONTH_SUMS} FROM clean GROUP BY 1)') + f"""
SELECT CAST(d.day_pos AS INTEGER) AS day_pos, d."Day",
       {", ".join(f'CASE WHEN h."Day" IS NULL THEN NULL ELSE {rnd_sql("COALESCE(h.m_" + m + ", 0.0)")} END AS "{m}"' for m in MONTHS)}
FROM dom d LEFT JOIN h USING ("Day")""")
def q_heatmap(spark, sf):
    return rounded(RU.heatmap(clean_sales_view(spark, sf)), R)


_RCLEAN_COLS = ["order_id", "invoice_date", "amount", "item", "market", "units", "Date", "Revenue", "Product",
                "Region", "Quantity", "MonthNum", "Month", "Quarter", "Week", "Day"]
_MISSING = " + ".join(
    f'(CASE WHEN "{c}" IS NULL{" OR isnan(" + chr(34) + c + chr(34) + ")" if c in ("Revenue", "Quantity") else ""} THEN 1 ELSE 0 END)'
    for c in _RCLEAN_COLS)


@query("data_quality", oracle=with_(CLEAN_RAW_ORDERS) + f"""
SELECT count(*) AS rows, CAST(sum({_MISSING}) AS BIGINT) AS missing_cells, min("Date") AS date_start,
       max("Date") AS date_end, count(*) * {len(_RCLEAN_COLS)} AS total_cells,
       {rnd_sql(f"CASE WHEN count(*) > 0 THEN sum({_MISSING}) / (count(*) * {len(_RCLEAN_COLS)}) * 100 ELSE 0.0 END")} AS missing_rate,
       CAST(COALESCE(datediff('day', min("Date"), max("Date")) + 1, 0) AS INTEGER) AS date_span_days,
       5 AS schema_fields
FROM rclean""")
def q_data_quality(spark, sf):
    return rounded(RU.data_quality(clean_raw_orders(spark, sf)), R)


# ---------------------------------------------------------------- anomalies

def _anomaly_sql(ctes: str, src: str, keys: list[str], first_only: bool) -> str:
    kq = [f'"{c}"' for c in keys]
    k = "".join(f"{c}, " for c in kq)
    part = ("PARTITION BY " + ", ".join(kq)) if keys else ""
    group = ("GROUP BY " + ", ".join(kq)) if keys else ""
    on = " AND ".join(f"f.{c} = b.{c}" for c in kq) or "true"
    daily_sql = f'SELECT {k}"Date" AS ds, sum("Revenue") AS y FROM {src} GROUP BY {k}"Date"'
    body = f"""
filled AS (
  SELECT {"".join(f"c.{c}, " for c in kq)}c.ds, COALESCE(d.y, 0.0) AS y
  FROM cal c LEFT JOIN daily d ON c.ds = d.ds{"".join(f" AND c.{c} = d.{c}" for c in kq)}),
b AS (SELECT {k}quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3, count(*) AS n FROM filled {group}),
fl AS (
  SELECT {"".join(f"f.{c}, " for c in kq)}f.ds, f.y, CASE WHEN f.y > b.q3 + 1.5 * (b.q3 - b.q1) THEN 'high' ELSE 'low' END AS type
  FROM filled f JOIN b ON {on}
  WHERE b.n >= 10 AND (f.y < b.q1 - 1.5 * (b.q3 - b.q1) OR f.y > b.q3 + 1.5 * (b.q3 - b.q1))),
r AS (SELECT *, row_number() OVER ({part} ORDER BY ds) AS rk FROM fl)
SELECT {k}strftime(ds, '%Y-%m-%d') AS date, {rnd_sql("y")} AS value, type, CAST(rk AS INTEGER) AS rank
FROM r{" WHERE rk <= 5" if first_only else ""}"""
    return with_(ctes, f"daily AS ({daily_sql})",
                 f"bounds AS (SELECT {k}min(ds) AS lo, max(ds) AS hi FROM daily {group})",
                 f"cal AS (SELECT {k}CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ds FROM bounds)") \
        .rstrip() + "," + body


@query("anomalies", oracle=_anomaly_sql(CLEAN_SALES, "clean", [], True))
def q_anomalies(spark, sf):
    return rounded(AN.detect_anomalies(clean_sales_view(spark, sf)), R)


@query("anomalies_all", oracle=_anomaly_sql(CLEAN_SALES, "clean", [], False))
def q_anomalies_all(spark, sf):
    return rounded(AN.detect_anomalies(clean_sales_view(spark, sf), first_only=False), R)


@query("anomalies_by_region", oracle=_anomaly_sql(CLEAN_SALES, "clean", ["Region"], True))
def q_anomalies_by_region(spark, sf):
    return rounded(AN.detect_anomalies(clean_sales_view(spark, sf), ["Region"]), R)


@query("anomalies_events", oracle=_anomaly_sql(CLEAN_EVENTS, "eclean", ["event_type"], False))
def q_anomalies_events(spark, sf):
    return rounded(AN.detect_anomalies(clean_events(spark, sf), ["event_type"], first_only=False), R)


# ---------------------------------------------------------------- insights, summary, risk, copilot

from ..operators import insights as INS  # noqa: E402
from ..operators import questions as QU  # noqa: E402
from . import text_sql as TS  # noqa: E402


@query("insights", oracle=TS.insights_sql(CLEAN_SALES, "clean", []))
def q_insights(spark, sf):
    return INS.generate_insights(clean_sales_view(spark, sf))


@query("insights_by_region", oracle=TS.insights_sql(CLEAN_SALES, "clean", ["Region"]))
def q_insights_by_region(spark, sf):
    return INS.generate_insights(clean_sales_view(spark, sf), ["Region"])


def _summary_out(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, "headline", "summary_text",
                     F.array_join("recommendations", "\n").alias("recommendations_text"),
                     F.size("recommendations").alias("n_recommendations"))


@query("executive_summary", oracle=TS.summary_sql(CLEAN_SALES, "clean", []))
def q_executive_summary(spark, sf):
    return _summary_out(INS.executive_summary(clean_sales_view(spark, sf)), [])


@query("executive_summary_by_product", oracle=TS.summary_sql(CLEAN_SALES, "clean", ["Product"]))
def q_executive_summary_by_product(spark, sf):
    return _summary_out(INS.executive_summary(clean_sales_view(spark, sf), ["Product"]), ["Product"])


@query("risk", oracle=TS.risk_sql(CLEAN_SALES, "clean", ["Region"]))
def q_risk(spark, sf):
    return rounded(INS.risk(clean_sales_view(spark, sf), ["Region"]), R)


def _user_turns(spark, sf):
    return TB.table(spark, sf, "conversations").where(F.col("role") == "user")


@query("intents", oracle=f"""
SELECT conv_id, turn, {TS.intent_sql('text')} AS intent FROM conversations WHERE role = 'user'""")
def q_intents(spark, sf):
    return _user_turns(spark, sf).select("conv_id", "turn", QU.intent(F.col("text")).alias("intent"))


@query("answers", oracle=TS.answers_sql(CLEAN_SALES, "clean"))
def q_answers(spark, sf):
    ctx = QU.chat_context(clean_sales_view(spark, sf))
    out = QU.answer_questions(_user_turns(spark, sf).select("conv_id", "turn", "text"), ctx)
    return out.select("conv_id", "turn", "intent", "answer")


@query("last_turns", oracle="""
SELECT conv_id, turn, role, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rk FROM conversations) WHERE rk <= 10""")
def q_last_turns(spark, sf):
    return QU.last_turns(TB.table(spark, sf, "conversations")).select("conv_id", "turn", "role", "text")


# ---------------------------------------------------------------- forecasting

from ..operators.forecast import base as FB  # noqa: E402
from ..operators.forecast import compare as FC  # noqa: E402
from ..operators.forecast import moving_average as FMA  # noqa: E402
from ..operators.forecast import ets as FETS  # noqa: E402
from ..operators.forecast import arima as FAR  # noqa: E402
from ..operators.forecast import trees as FTR  # noqa: E402


def _sales_series(spark, sf, keys):
    return S.gap_fill(S.daily(clean_sales_view(spark, sf), keys), keys).select(*keys, "ds", "y")


def _events_series(spark, sf):
    ev = TB.table(spark, sf, "events")
    return S.prepare_daily_series(ev, ["event_type"], date_col="ts", value_col="value").select("event_type", "ds", "y")


def _ma_sql(ctes: str, daily_sql: str, keys: list[str], backtest: bool) -> str:
    """Oracle for M2 + M3 (+ A21 when `backtest`): gap-fill, clamp horizon, moving average."""
    kq = [f'"{c}"' for c in keys] or ['"seg"']
    kl = ", ".join(kq)
    seg = "" if keys else ', 1 AS "seg"'
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in kq)
    outk = "".join(f'{c}, ' for c in [f'"{x}"' for x in keys])
    body = with_(ctes, f"daily AS (SELECT *{seg} FROM ({daily_sql}))",
                 f"bounds AS (SELECT {kl}, min(ds) AS lo, max(ds) AS hi FROM daily GROUP BY {kl})",
                 f"""cal AS (SELECT {kl}, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ds, lo,
                       CAST(datediff('day', lo, hi) + 1 AS INTEGER) AS n FROM bounds)""",
                 f"""filled AS (SELECT {", ".join("c." + c for c in kq)}, c.ds, COALESCE(d.y, 0.0) AS y,
                       CAST(datediff('day', c.lo, c.ds) AS INTEGER) AS t, c.n,
                       greatest(3, least(30, greatest(3, c.n // 4))) AS h
                     FROM cal c LEFT JOIN daily d ON c.ds = d.ds AND {on('c', 'd')})""",
                 (f"req AS (SELECT {kl}, ds, y, t, n - h AS n, h FROM filled WHERE n >= 20 AND t < n - h)" if backtest
                  else f"req AS (SELECT {kl}, ds, y, t, n, h FROM filled)"),
                 f"""rm AS (SELECT *, CASE WHEN n >= 7
                       THEN avg(y) OVER (PARTITION BY {kl} ORDER BY t ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
                       ELSE avg(y) OVER (PARTITION BY {kl} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                       END AS r FROM req)""",
                 f"""st AS (SELECT {kl}, avg(CASE WHEN t >= n - least(7, n) THEN y END) AS level,
                       COALESCE(stddev_pop(y - r), 0.0) AS sigma, max(ds) AS last_ds, max(h) AS h
                     FROM rm GROUP BY {kl})""",
                 f"""fc AS (SELECT {kl}, CAST(unnest(generate_series(1, h)) AS INTEGER) AS step, level, sigma, last_ds FROM st)""")
    rows = f"""SELECT {", ".join("fc." + c for c in kq)}, fc.step, CAST(fc.last_ds + fc.step AS DATE) AS ds, fc.level AS forecast,
       greatest(fc.level - 1.96 * fc.sigma, 0.0) AS lower, greatest(fc.level + 1.96 * fc.sigma, 0.0) AS upper FROM fc"""
    if not backtest:
        return body + f"""SELECT {outk}'Moving Average' AS model, step, ds, {rnd_sql("forecast")} AS forecast,
       {rnd_sql("lower")} AS lower, {rnd_sql("upper")} AS upper FROM ({rows})"""
    outp = "".join(f'p."{x}", ' for x in keys)
    return body + f""", p AS ({rows})
SELECT {outp}'Moving Average' AS model, {rnd_sql("avg(abs(f.y - p.forecast))")} AS mae,
       {rnd_sql("sqrt(avg((f.y - p.forecast) * (f.y - p.forecast)))")} AS rmse,
       {rnd_sql(rnd_sig_sql("avg(abs((f.y - p.forecast) / greatest(abs(f.y), 1e-6))) * 100"))} AS mape
FROM p JOIN filled f ON p.ds = f.ds AND {on('p', 'f')} GROUP BY {", ".join("p." + c for c in kq)}"""


_SALES_DAILY = 'SELECT "Date" AS ds, sum("Revenue") AS y FROM clean GROUP BY 1'
_SALES_DAILY_REGION = 'SELECT "Region", "Date" AS ds, sum("Revenue") AS y FROM clean GROUP BY 1, 2'
_EVENTS_DAILY = ("SELECT event_type, CAST(ts AS DATE) AS ds, sum(COALESCE(value, 0.0)) AS y FROM events "
                 "WHERE ts IS NOT NULL GROUP BY 1, 2")


def _ma_query(series, keys):
    req = FB.full_request(FB.plan_requests(series, keys, 30), keys)
    return rounded(FMA.moving_average(req, keys), R)


@query("moving_average_forecast", oracle=_ma_sql(CLEAN_SALES, _SALES_DAILY, [], False))
def q_moving_average_forecast(spark, sf):
    return _ma_query(_sales_series(spark, sf, []), [])


@query("moving_average_events", oracle=_ma_sql("ev AS (SELECT 1)", _EVENTS_DAILY, ["event_type"], False))
def q_moving_average_events(spark, sf):
    return _ma_query(_events_series(spark, sf), ["event_type"])


@query("forecast_metrics", oracle=_ma_sql(CLEAN_SALES, _SALES_DAILY_REGION, ["Region"], True))
def q_forecast_metrics(spark, sf):
    keys = ["Region"]
    plan = FB.plan_requests(_sales_series(spark, sf, keys), keys, 30)
    fc = FMA.moving_average(FB.train_request(plan, keys), keys)
    sc = FB.score(fc.select(*keys, "model", "ds", "forecast"), plan.where(F.col("split") == "test"), keys)
    # MAPE spans many decades when actual days are zero: compare 6 significant digits
    return rounded(sc.withColumn("mape", rnd_sig(F.col("mape"))), R)


_LAGS = ", ".join(f"lag(y, {k}) OVER w AS lag_{k}" for k in range(1, 22))
_ROLL = ", ".join(
    f"CASE WHEN count(y) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) = {n} "
    f"THEN {fn}(y) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END AS roll_{nm}_{n}"
    for nm, fn in (("mean", "avg"), ("std", "stddev_samp")) for n in (7, 14))
# window means of 1e-4-grid values sit on ties at 4 decimals; cents are tie-free here
_FEAT_DIGITS = {"roll_mean_7": 2, "roll_mean_14": 2}
_FEAT_COLS = ["ds", "y"] + [f"lag_{k}" for k in range(1, 22)] + [
    "roll_mean_7", "roll_mean_14", "roll_std_7", "roll_std_14", "dayofweek", "month", "day"]


@query("supervised_features", oracle=_gapfill_sql(CLEAN_SALES, _SALES_DAILY, [], round_y=False).replace(
    "\nSELECT c.ds, ", "\n, g AS (SELECT c.ds, ", 1) + f"""
)
SELECT {", ".join(c if c in ("ds", "dayofweek", "month", "day") else f"{rnd_sql(c, _FEAT_DIGITS.get(c, R))} AS {c}" for c in _FEAT_COLS)}
FROM (SELECT ds, y, {_LAGS}, {_ROLL}, CAST(isodow(ds) - 1 AS INTEGER) AS dayofweek,
             CAST(month(ds) AS INTEGER) AS month, CAST(day(ds) AS INTEGER) AS day,
             row_number() OVER w AS rn
      FROM g WINDOW w AS (ORDER BY ds)) WHERE rn > 21""")
def q_supervised_features(spark, sf):
    return rounded(S.supervised_features(_sales_series(spark, sf, []), [], 21), R, _FEAT_DIGITS)


def _ets_sql(ctes: str, daily_sql: str, key: str) -> str:
    """Oracle for M6: the same Holt–Winters fold as a recursive CTE over the same grid, with
    the operations in the same order (sequential sums, identical update formulas)."""
    from itertools import product as _product
    kq = f'"{key}"'
    grid = ", ".join(f"(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({g} AS DOUBLE))"
                     for a, b, g in _product(FETS.ALPHAS, FETS.BETAS, FETS.GAMMAS))
    g0 = FETS.GAMMAS[0]
    return with_(
        ctes, f"daily AS ({daily_sql})",
        f"bounds AS (SELECT {kq}, min(ds) AS lo, max(ds) AS hi FROM daily GROUP BY {kq})",
        f"""cal AS (SELECT {kq}, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ds, lo,
               CAST(datediff('day', lo, hi) + 1 AS INTEGER) AS n FROM bounds)""",
        f"""filled AS (SELECT c.{kq}, c.ds, COALESCE(d.y, 0.0) AS y, CAST(datediff('day', c.lo, c.ds) AS INTEGER) AS t,
               c.n, greatest(3, least(30, greatest(3, c.n // 4))) AS h
             FROM cal c LEFT JOIN daily d ON c.ds = d.ds AND c.{kq} = d.{kq})""",
        f"""ini AS (SELECT {kq}, n, h, max(ds) AS last_ds, list(y ORDER BY t) AS ys FROM filled GROUP BY {kq}, n, h)""",
        f"""ini2 AS (SELECT *, n >= {FETS.MIN_SEASONAL} AS seasonal, ys[1:7] AS wk1, ys[8:14] AS wk2 FROM ini)""",
        f"""ini3 AS (SELECT *, list_reduce(list_prepend(CAST(0.0 AS DOUBLE), wk1), lambda a, x: a + x) / len(wk1) AS m1,
               list_reduce(list_prepend(CAST(0.0 AS DOUBLE), wk2), lambda a, x: a + x) / len(wk2) AS m2 FROM ini2)""",
        f"""st0 AS (SELECT {kq}, n, h, last_ds,
               CASE WHEN seasonal THEN m1 ELSE ys[1] END AS l,
               CASE WHEN seasonal THEN (m2 - m1) / 7 WHEN n >= 2 THEN ys[2] - ys[1] ELSE CAST(0.0 AS DOUBLE) END AS b,
               CASE WHEN seasonal THEN list_transform(wk1, lambda x: x - m1) ELSE CAST([0, 0, 0, 0, 0, 0, 0] AS DOUBLE[]) END AS s,
               seasonal FROM ini3)""",
        f"""grid AS (SELECT * FROM (VALUES {grid}) v(alpha, beta, graw))""",
        f"""start AS (SELECT st0.*, alpha, beta, graw, CASE WHEN seasonal THEN graw ELSE CAST(0.0 AS DOUBLE) END AS gam
                  FROM st0, grid WHERE seasonal OR graw = {g0})""",
        f"""RECURSIVE rec AS (
  SELECT {kq}, n, h, last_ds, alpha, beta, graw, gam, 0 AS t, l, b, s, CAST(0.0 AS DOUBLE) AS sse, CAST(0.0 AS DOUBLE) AS se FROM start
  UNION ALL
  SELECT {kq}, n, h, last_ds, alpha, beta, graw, gam, t + 1, lvl,
         beta * (lvl - l) + (1 - beta) * b,
         list_transform(s, lambda x, j: CASE WHEN j - 1 = t % 7 THEN gam * (y - lvl) + (1 - gam) * sv ELSE x END),
         sse + err * err, se + err
  FROM (SELECT r.*, f.y, r.s[(r.t % 7) + 1] AS sv,
               f.y - (r.l + r.b + r.s[(r.t % 7) + 1]) AS err,
               r.alpha * (f.y - r.s[(r.t % 7) + 1]) + (1 - r.alpha) * (r.l + r.b) AS lvl
        FROM rec r JOIN filled f ON f.{kq} = r.{kq} AND f.t = r.t))""",
        f"""fin AS (SELECT * FROM rec WHERE t = n)""",
        f"""best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {kq} ORDER BY sse, alpha, beta, graw) AS rk
                                  FROM fin) WHERE rk = 1)""",
        f"""fc AS (SELECT {kq}, last_ds, n, l, b, s,
                  sqrt(greatest(sse / n - (se / n) * (se / n), 0.0)) AS sigma,
                  CAST(unnest(generate_series(1, h)) AS INTEGER) AS step FROM best)""",
    ).replace("WITH ", "WITH RECURSIVE ", 1).replace("RECURSIVE rec AS", "rec AS") + f"""
SELECT {kq}, 'Exponential Smoothing' AS model, step, CAST(last_ds + step AS DATE) AS ds,
       {rnd_sql("l + step * b + s[((n + step - 1) % 7) + 1]")} AS forecast,
       {rnd_sql("greatest(l + step * b + s[((n + step - 1) % 7) + 1] - 1.96 * sigma, 0.0)")} AS lower,
       {rnd_sql("greatest(l + step * b + s[((n + step - 1) % 7) + 1] + 1.96 * sigma, 0.0)")} AS upper
FROM fc"""


@query("ets_forecast")
def q_ets_forecast(spark, sf):
    """The optimised forecast; `ets_optimum_check` tests its optimum, `ets_grid_forecast` states the grid it starts from."""
    keys = ["Region"]
    req = FB.full_request(FB.plan_requests(_sales_series(spark, sf, keys), keys, 30), keys)
    return rounded(FETS.ets(req, keys, refine=True), R)


@query("arima_grid_best")
def q_arima_grid_best(spark, sf):
    keys = ["Region"]
    req = FB.train_request(FB.plan_requests(_sales_series(spark, sf, keys), keys, 30), keys)
    return FAR.arima(req, keys).groupBy(*keys).agg(F.first("extra").alias("config"), F.first("aic").alias("aic"),
                                                   F.count(F.lit(1)).alias("steps"))


@query("arima_forecast")
def q_arima_forecast(spark, sf):
    keys = ["Region"]
    req = FB.full_request(FB.plan_requests(_sales_series(spark, sf, keys), keys, 30), keys)
    return FAR.arima(req, keys).drop("cid", "aic")


@query("forest_forecast")
def q_forest_forecast(spark, sf):
    keys = ["Region"]
    req = FB.train_request(FB.plan_requests(_sales_series(spark, sf, keys), keys, 30), keys)
    return FTR.forest_forecast(req, keys)


@query("boosting_forecast")
def q_boosting_forecast(spark, sf):
    keys = ["Region"]
    req = FB.train_request(FB.plan_requests(_sales_series(spark, sf, keys), keys, 30), keys)
    return FTR.boosting_forecast(req, keys)


@query("model_comparison")
def q_model_comparison(spark, sf):
    keys = ["Region"]
    return FC.compare_forecasting_models(_sales_series(spark, sf, keys), keys, 30, refit=False).comparison


@query("best_forecast")
def q_best_forecast(spark, sf):
    keys = ["Region"]
    return FC.compare_forecasting_models(_sales_series(spark, sf, keys), keys, 30).forecast


@query("forecast_summary")
def q_forecast_summary(spark, sf):
    keys = ["Region"]
    return FC.compare_forecasting_models(_sales_series(spark, sf, keys), keys, 30).summary


# ---------------------------------------------------------------- users and sessions

from ..operators import users as US  # noqa: E402

AS_OF = "2024-01-20 00:00:00"
_USERS_SQL = """users_v AS (
  SELECT c_custkey AS id, lower(regexp_replace(c_name, '[^A-Za-z0-9]+', '.', 'g')) || '@example.com' AS email,
         CASE WHEN lower(c_mktsegment) = 'building' THEN 'admin' WHEN lower(c_mktsegment) = 'machinery' THEN 'analyst'
              ELSE 'viewer' END AS role
  FROM customer)"""
_SESSIONS_SQL = """sessions_v AS (
  SELECT event_id AS id, 'tok-' || CAST(event_id AS VARCHAR) AS token, user_id, ts AS created_at,
         ts + INTERVAL 7 DAY AS expires_at FROM events)"""


@query("screen_signups", oracle=with_(_USERS_SQL, """req AS (
  SELECT c_custkey AS request_id,
    CASE WHEN c_custkey % 11 = 0 THEN '  '
         WHEN c_custkey % 7 = 0 THEN replace(' ' || upper(lower(regexp_replace(c_name, '[^A-Za-z0-9]+', '.', 'g')) || '@' ||
              CASE WHEN lower(c_mktsegment) = 'building' THEN 'example.com' ELSE 'example.org' END) || ' ', '@', ' at ')
         ELSE ' ' || upper(lower(regexp_replace(c_name, '[^A-Za-z0-9]+', '.', 'g')) || '@' ||
              CASE WHEN lower(c_mktsegment) = 'building' THEN 'example.com' ELSE 'example.org' END) || ' ' END AS email_raw,
    CASE WHEN c_custkey % 3 = 0 THEN ' Admin ' WHEN c_custkey % 3 = 1 THEN 'analyst' ELSE c_mktsegment END AS role_raw
  FROM customer)""", """r AS (
  SELECT request_id, lower(trim(email_raw)) AS email,
         CASE WHEN lower(trim(role_raw)) IN ('viewer', 'analyst', 'admin') THEN lower(trim(role_raw)) ELSE 'viewer' END AS role
  FROM req)""", """r2 AS (
  SELECT r.*, e.email IS NOT NULL AS taken, row_number() OVER (PARTITION BY r.email ORDER BY request_id) AS rn
  FROM r LEFT JOIN (SELECT DISTINCT lower(trim(email)) AS email FROM users_v) e USING (email))""") + """
SELECT request_id, email, role,
  CASE WHEN email = '' OR NOT contains(email, '@') OR taken OR rn > 1 THEN 'rejected' ELSE 'ok' END AS status,
  CASE WHEN email = '' OR NOT contains(email, '@') THEN 'Invalid email address.'
       WHEN taken OR rn > 1 THEN 'Email already exists.' END AS reason
FROM r2""")
def q_screen_signups(spark, sf):
    return US.screen_signups(TB.signup_requests(spark, sf), TB.users(spark, sf))


@query("active_sessions", oracle=with_(_USERS_SQL, _SESSIONS_SQL) + f"""
SELECT s.token, s.user_id, u.email, u.role, s.expires_at
FROM sessions_v s JOIN users_v u ON u.id = s.user_id WHERE s.expires_at >= TIMESTAMP '{AS_OF}'""")
def q_active_sessions(spark, sf):
    return US.active_sessions(TB.sessions(spark, sf), TB.users(spark, sf), AS_OF)


@query("purge_expired", oracle=with_(_SESSIONS_SQL) + f"""
SELECT id, token, user_id, created_at, expires_at FROM sessions_v WHERE expires_at >= TIMESTAMP '{AS_OF}'""")
def q_purge_expired(spark, sf):
    return US.purge_expired(TB.sessions(spark, sf), AS_OF)


# ---------------------------------------------------------------- sources, sinks, documents

from ..operators import report as RP  # noqa: E402
from ..sources import files as FS  # noqa: E402


@query("ingest_manifest")
def q_ingest_manifest(spark, sf):
    """Writes `raw_orders` as CSV into the shared scratch folder, then scans it back."""
    path = FS.scratch_path(spark, "raw_orders_csv")
    TB.raw_orders(spark, sf).write.mode("overwrite").option("header", True).csv(path)
    return FS.ingest_manifest(FS.read_upload(spark, path, "csv"))


@query("csv_roundtrip_clean", oracle=with_(CLEAN_RAW_ORDERS) + """
SELECT order_id, "Date", """ + rnd_sql('"Revenue"') + """ AS "Revenue", "Product", COALESCE(NULLIF("Region", ''), 'Unknown') AS "Region",
       """ + rnd_sql('"Quantity"') + """ AS "Quantity", "MonthNum", "Month", "Quarter", "Week", "Day" FROM rclean""")
def q_csv_roundtrip_clean(spark, sf):
    """`raw_orders` cleaned, written as CSV by the cleaned-data sink (S6), read back with inferred
    types (S1) and cleaned again: the cleaner leaves cleaned rows as they are (but for the
    empty region, which CSV cannot tell from a missing one)."""
    path = FS.scratch_path(spark, "cleaned_csv")
    FS.write_cleaned(clean_raw_orders(spark, sf).select("order_id", *C.STANDARD_COLUMNS), path)
    again = C.clean_upload(FS.read_upload(spark, path, "csv"))[0]
    return rounded(again.select(F.col("order_id").cast("bigint").alias("order_id"), *C.CLEAN_COLUMNS), R)


@query("sample_rows", oracle=with_(CLEAN_SALES) + """
SELECT "Date", """ + rnd_sql('"Revenue"') + """ AS "Revenue", "Product", "Region" FROM clean
ORDER BY "Date", "Revenue" DESC LIMIT 10""")
def q_sample_rows(spark, sf):
    top = FS.sample_rows(clean_sales_view(spark, sf), 10, ("Date", F.col("Revenue").desc()))
    return rounded(top.select("Date", "Revenue", "Product", "Region"), R)


@query("report_document")
def q_report_document(spark, sf):
    clean, roles = C.clean_sales(TB.sales(spark, sf))
    return RP.analysis_document(clean, roles, ["Region"]).select("Region", "document")


@query("report_insights_roundtrip", oracle=TS.insights_sql(CLEAN_SALES, "clean", ["Region"]))
def q_report_insights_roundtrip(spark, sf):
    clean, roles = C.clean_sales(TB.sales(spark, sf))
    return RP.insights_from_document(RP.analysis_document(clean, roles, ["Region"]), ["Region"])


# Probe questions, one per intent (and the reference's two substring traps), asked next to
# every user turn so each answer template is checked against the oracle.
PROBE_QUESTIONS = [
    "What is the top product?", "Any weak product to review?", "Which region needs attention?",
    "Show the weak region", "Is revenue growth positive?", "What is the profit margin?",
    "Show me the forecast outlook.", "Is the business stable?", "Give me a short business summary.",
    "What should I do next?", "Which product is performing best?", "How many transactions?",
]
_PROBE_VALUES = ", ".join(f"(-1, {i}, {TS.lit(q)})" for i, q in enumerate(PROBE_QUESTIONS))


@query("answers_with_probes", oracle=TS.answers_sql(CLEAN_SALES, "clean").replace(
    "FROM conversations WHERE role = 'user')",
    f"FROM (SELECT conv_id, turn, text FROM conversations WHERE role = 'user' "
    f"UNION ALL SELECT * FROM (VALUES {_PROBE_VALUES}) v(conv_id, turn, text)))"))
def q_answers_with_probes(spark, sf):
    probes = spark.createDataFrame([(-1, i, q) for i, q in enumerate(PROBE_QUESTIONS)],
                                   "conv_id bigint, turn bigint, text string")
    qs = _user_turns(spark, sf).select("conv_id", "turn", "text").unionByName(probes)
    out = QU.answer_questions(qs, QU.chat_context(clean_sales_view(spark, sf)))
    return out.select("conv_id", "turn", "intent", "answer")
