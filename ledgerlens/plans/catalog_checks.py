"""Queries over odd inputs (date layouts, NaN, dotted headers, null emails), sinks read back, and
checks of the forecasts that SQL can state exactly. The oracles state the expected values
themselves: dates come from the order's own date, not from a parse."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import insights as INS
from ..operators import questions as QU
from ..operators import report as RP
from ..operators import users as US
from ..operators.forecast import base as FB
from ..operators.forecast import compare as FC
from ..operators.forecast import moving_average as FMA
from ..sources import tables as TB
from . import catalog as K
from . import text_sql as TS
from .oracle_sql import CLEAN_SALES, RAW_ORDERS, with_
from .registry import query, rounded

_N = len(TB.DATE_LAYOUTS)
_DATED = f"""dated AS (
  SELECT o_orderkey AS order_id, CAST(o_orderkey % {_N} AS INTEGER) AS layout, CAST(o_orderdate AS DATE) AS d,
         CAST(floor(o_totalprice) AS BIGINT) AS amount FROM orders),
expected AS (
  SELECT *, CASE WHEN layout IN (16, 17) THEN NULL WHEN layout IN (1, 12) THEN CAST(date_trunc('month', d) AS DATE) ELSE d END AS day
  FROM dated)"""


@query("parse_date_layouts", oracle=f"WITH {_DATED} SELECT order_id, layout, day AS parsed_date FROM expected")
def q_parse_date_layouts(spark, sf):
    """Every supported text layout, with times, zones and fractions, and text that is no date."""
    from ..functions.dates import to_day
    d = TB.dated_orders(spark, sf)
    return d.select("order_id", "layout", to_day(F.col("order_date"), d.schema["order_date"].dataType).alias("parsed_date"))


@query("date_parse_counts", oracle=f"""WITH {_DATED}
SELECT layout, count(*) AS n_rows, count(day) AS parsed, CAST(count(*) FILTER (layout = 17) AS BIGINT) AS missing,
       CAST(count(*) FILTER (layout = 16) AS BIGINT) AS not_a_date FROM expected GROUP BY layout""")
def q_date_parse_counts(spark, sf):
    """How many dates of each layout were read, were missing, or could not be read."""
    parsed = q_parse_date_layouts(spark, sf)
    text = TB.dated_orders(spark, sf).select("order_id", "order_date")
    both = parsed.join(text, "order_id")
    return both.groupBy("layout").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("parsed_date").alias("parsed"),
        F.count_if(F.col("order_date").isNull()).alias("missing"),
        F.count_if(F.col("order_date").isNotNull() & F.col("parsed_date").isNull()).alias("not_a_date"))


@query("clean_dated", oracle=f"""WITH {_DATED}
SELECT order_id, day AS "Date", CAST(amount AS DOUBLE) AS "Revenue" FROM expected WHERE day IS NOT NULL""")
def q_clean_dated(spark, sf):
    """The cleaner over mixed layouts keeps every row whose date can be read."""
    return C.clean_sales(TB.dated_orders(spark, sf).drop("layout"))[0].select("order_id", "Date", "Revenue")


@query("clean_nan", oracle="""
SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS "Date",
       CASE WHEN o_orderkey % 5 IN (0, 1) THEN 0.0 ELSE CAST(floor(o_totalprice) AS DOUBLE) END AS "Revenue",
       CASE WHEN o_orderkey % 7 = 0 THEN 0.0 ELSE CAST(o_orderkey % 50 AS DOUBLE) END AS "Quantity"
FROM orders WHERE o_orderdate IS NOT NULL""")
def q_clean_nan(spark, sf):
    """NaN and null in revenue and quantity become zero."""
    out = C.clean_sales(TB.nan_orders(spark, sf))[0]
    return out.select("order_id", "Date", "Revenue", "Quantity")


@query("clean_dotted", oracle="""
SELECT o_orderkey AS "order.key", CAST(o_orderdate AS DATE) AS "Date", CAST(floor(o_totalprice) AS DOUBLE) AS "Revenue",
       o_orderpriority AS "Product", o_orderstatus AS "Region", CAST(o_orderkey % 9 AS DOUBLE) AS "Quantity"
FROM orders WHERE o_orderdate IS NOT NULL""")
def q_clean_dotted(spark, sf):
    """Headers with dots."""
    out = C.clean_sales(TB.dotted_orders(spark, sf))[0]
    return out.select(F.col("`order.key`"), *C.STANDARD_COLUMNS)


@query("screen_odd_signups", oracle="""
WITH u AS (SELECT DISTINCT lower(regexp_replace(c_name, '[^A-Za-z0-9]+', '.', 'g')) || '@example.com' AS email FROM customer),
r AS (SELECT c_custkey AS request_id, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'nobody'
        WHEN 3 THEN 'user' || CAST(c_custkey % 20 AS VARCHAR) || '@example.net'
        ELSE lower(regexp_replace(c_name, '[^A-Za-z0-9]+', '.', 'g')) || '@example.com' END AS email FROM customer),
x AS (SELECT r.*, u.email IS NOT NULL AS taken, row_number() OVER (PARTITION BY r.email ORDER BY request_id) AS rn
      FROM r LEFT JOIN u ON r.email = u.email)
SELECT request_id, email, 'viewer' AS role,
       CASE WHEN email IS NULL OR NOT contains(email, '@') OR taken OR rn > 1 THEN 'rejected' ELSE 'ok' END AS status,
       CASE WHEN email IS NULL OR NOT contains(email, '@') THEN 'Invalid email address.'
            WHEN taken OR rn > 1 THEN 'Email already exists.' END AS reason FROM x""")
def q_screen_odd_signups(spark, sf):
    """Null and many blank emails: every request is in the result."""
    return US.screen_signups(TB.odd_signups(spark, sf), TB.users(spark, sf))


# ---------------------------------------------------------------- files and documents

@query("ingest_manifest_totals", oracle=with_(RAW_ORDERS) + """
SELECT count(*) AS n_rows, 'order_id,invoice_date,amount,item,market,units' AS columns FROM raw_orders""")
def q_ingest_manifest_totals(spark, sf):
    """The manifest's rows and columns over all its files (their names and times differ from run to run)."""
    manifest = K.q_ingest_manifest(spark, sf)
    return manifest.groupBy(F.array_join("columns", ",").alias("columns")).agg(F.sum("rows").alias("n_rows")).select("n_rows", "columns")


_DOC = ["total_revenue", "total_records", "margin_pct", "unique_products", "top_product", "growth_pct"]


@query("report_document_kpis", oracle=K._kpi_sql(CLEAN_SALES, "clean", ["Region"], _DOC))
def q_report_document_kpis(spark, sf):
    """KPI fields read back from the JSON documents."""
    docs = K.q_report_document(spark, sf)
    types = {"total_records": "bigint", "unique_products": "bigint", "top_product": "string"}
    schema = "struct<kpis: struct<" + ", ".join(f"{c}: {types.get(c, 'double')}" for c in _DOC) + ">>"
    return rounded(docs.select("Region", F.from_json("document", schema).alias("d")).select(
        "Region", *[F.col(f"d.kpis.{c}").alias(c) for c in _DOC]))


# ---------------------------------------------------------------- forecasts

_SERIES = f"""daily AS ({K._SALES_DAILY_REGION}),
bounds AS (SELECT "Region", min(ds) AS lo, max(ds) AS hi FROM daily GROUP BY 1),
sized AS (SELECT *, CAST(datediff('day', lo, hi) + 1 AS INTEGER) AS n FROM bounds),
plan AS (SELECT *, CAST(greatest(3, least(30, greatest(3, n // 4))) AS INTEGER) AS h FROM sized)"""


@query("forecast_plan", oracle=with_(CLEAN_SALES, _SERIES) + """
SELECT "Region", n, h, n - h AS n_train, CASE WHEN n < 20 THEN 0 ELSE CAST(n - h AS BIGINT) END AS train_days,
       CASE WHEN n < 20 THEN 0 ELSE CAST(h AS BIGINT) END AS test_days, hi AS last_day FROM plan""")
def q_forecast_plan(spark, sf):
    """Series length, clamped horizon and train/hold-out split of every segment."""
    plan = FB.plan_requests(K._sales_series(spark, sf, ["Region"]), ["Region"], 30)
    return plan.groupBy("Region").agg(
        F.max("n").alias("n"), F.max("h").alias("h"), F.max("n_train").alias("n_train"),
        F.count_if(F.col("split") == "train").alias("train_days"),
        F.count_if(F.col("split") == "test").alias("test_days"), F.max("ds").alias("last_day"))


_CHECK = """h AS steps, CAST(hi + 1 AS DATE) AS first_day, CAST(hi + h AS DATE) AS last_day, true AS consecutive,
       true AS in_band, true AS finite"""


def _check(forecast):
    """What any forecast must satisfy: h consecutive days, values inside their band, all finite."""
    ok = F.col("forecast").between(F.col("lower"), F.col("upper"))
    finite = ~(F.isnan("forecast") | F.isnan("lower") | F.isnan("upper")) & (F.abs("forecast") < float("inf"))
    return forecast.groupBy("Region").agg(
        F.count(F.lit(1)).cast("int").alias("steps"), F.min("ds").alias("first_day"), F.max("ds").alias("last_day"),
        ((F.count_distinct("ds") == F.count(F.lit(1))) & (F.max("step") == F.count(F.lit(1)))).alias("consecutive"),
        F.every(ok).alias("in_band"), F.every(finite).alias("finite"))


@query("arima_forecast_check", oracle=with_(CLEAN_SALES, _SERIES) + f'SELECT "Region", {_CHECK} FROM plan')
def q_arima_forecast_check(spark, sf):
    return _check(K.q_arima_forecast(spark, sf))


@query("ets_forecast_check", oracle=with_(CLEAN_SALES, _SERIES) + f'SELECT "Region", {_CHECK} FROM plan')
def q_ets_forecast_check(spark, sf):
    """The lower bound is cut at zero, so a negative forecast may lie below it: checked against the cut value."""
    f = K.q_ets_forecast(spark, sf).withColumn("forecast", F.greatest("forecast", F.lit(0.0)))
    return _check(f)


@query("best_forecast_check", oracle=with_(CLEAN_SALES, _SERIES) + """
SELECT "Region", h AS steps, CAST(hi + h AS DATE) AS last_day, 4 AS models_compared, true AS best_has_least_mape,
       true AS totals_agree FROM plan""")
def q_best_forecast_check(spark, sf):
    """The comparison names four models, the best has the least MAPE, and sum and average of the
    forecast rows agree with the summary."""
    keys = ["Region"]
    r = FC.compare_forecasting_models(K._sales_series(spark, sf, keys), keys, 30)
    models = r.comparison.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("int").alias("models_compared"), F.min("mape").alias("least"),
        F.map_from_entries(F.collect_list(F.struct("model", "mape"))).alias("mapes"))
    rows = r.forecast.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("steps"), F.max("ds").alias("last_day"),
                                         F.sum("forecast").alias("s"), F.avg("forecast").alias("a"))
    out = r.summary.join(models, keys).join(rows, keys)
    near = lambda x, y: F.abs(F.col(x) - F.col(y)) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(F.col(y)))
    return out.select(*keys, "steps", "last_day", "models_compared",
                      (F.try_element_at("mapes", F.col("best_model")) == F.col("least")).alias("best_has_least_mape"),
                      (near("forecast_sum", "s") & near("forecast_average", "a")).alias("totals_agree"))


# ---------------------------------------------------------------- texts with a forecast

def _moving_average_total(spark, sf, keys):
    """(keys…, best_model, forecast_sum) of the moving-average forecast."""
    request = FB.full_request(FB.plan_requests(K._sales_series(spark, sf, keys), keys, 30), keys)
    rows = FMA.moving_average(request, keys)
    return rows.groupBy(*keys, F.col("model").alias("best_model")).agg(F.sum("forecast").alias("forecast_sum"))


@query("executive_summary_forecast", oracle=TS.summary_sql(CLEAN_SALES, "clean", ["Region"], forecast=True))
def q_executive_summary_forecast(spark, sf):
    """Summary and recommendations with a forecast present."""
    keys = ["Region"]
    out = INS.executive_summary(K.clean_sales_view(spark, sf), keys, _moving_average_total(spark, sf, keys))
    return K._summary_out(out, keys)


@query("answers_forecast", oracle=TS.answers_sql(CLEAN_SALES, "clean", forecast=True).replace(
    "FROM conversations WHERE role = 'user')",
    f"FROM (SELECT conv_id, turn, text FROM conversations WHERE role = 'user' "
    f"UNION ALL SELECT * FROM (VALUES {K._PROBE_VALUES}) v(conv_id, turn, text)))"))
def q_answers_forecast(spark, sf):
    """Every user turn and the probes, answered with a forecast present."""
    probes = spark.createDataFrame([(-1, i, q) for i, q in enumerate(K.PROBE_QUESTIONS)], "conv_id bigint, turn bigint, text string")
    asked = K._user_turns(spark, sf).select("conv_id", "turn", "text").unionByName(probes)
    context = QU.chat_context(K.clean_sales_view(spark, sf), [], _moving_average_total(spark, sf, []))
    return QU.answer_questions(asked, context).select("conv_id", "turn", "intent", "answer")


@query("report_document_forecast", oracle=with_(CLEAN_SALES, _SERIES) + """
SELECT "Region", 'Moving Average' AS best_model, h AS horizon, CAST(h AS BIGINT) AS n_rows,
       strftime(hi + 1, '%Y-%m-%d') AS first_date FROM plan""")
def q_report_document_forecast(spark, sf):
    """The forecast part of the JSON document, read back."""
    keys = ["Region"]
    clean, roles = C.clean_sales(TB.sales(spark, sf))
    request = FB.full_request(FB.plan_requests(K._sales_series(spark, sf, keys), keys, 30), keys)
    rows = FMA.moving_average(request, keys)
    summary = rows.groupBy(*keys, F.col("model").alias("best_model")).agg(
        F.max("step").alias("horizon"), F.sum("forecast").alias("forecast_sum"), F.avg("forecast").alias("forecast_average"),
        F.lit("").alias("message"))
    docs = RP.analysis_document(clean, roles, keys, summary, rows)
    schema = "struct<forecast: struct<best_model: string, horizon: int>, forecast_rows: array<struct<step: int, date: string>>>"
    return docs.select("Region", F.from_json("document", schema).alias("d")).select(
        "Region", "d.forecast.best_model", "d.forecast.horizon", F.size("d.forecast_rows").cast("bigint").alias("n_rows"),
        F.col("d.forecast_rows")[0]["date"].alias("first_date"))


@query("last_three_turns", oracle="""
SELECT conv_id, turn, role, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rk FROM conversations) WHERE rk <= 3""")
def q_last_three_turns(spark, sf):
    """The history cut at three turns: most conversations are longer, so the cut shows."""
    return QU.last_turns(TB.table(spark, sf, "conversations"), 3).select("conv_id", "turn", "role", "text")
