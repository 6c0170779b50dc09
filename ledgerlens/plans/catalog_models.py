"""Queries over fitted models and their store, stored tables and files, with what SQL can state of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import report as RP
from ..operators import schema_map as M
from ..operators import users as US
from ..operators.forecast import arima as FAR
from ..operators.forecast import base as FB
from ..operators.forecast import ets as FETS
from ..operators.forecast import moving_average as FMA
from ..operators.forecast import store as ST
from ..sources import files as FS
from ..sources import tables as TB
from . import catalog as K
from .catalog_checks import _SERIES
from .oracle_sql import CLEAN_SALES, RAW_ORDERS, with_
from .registry import query, rnd_sql, rounded

_KEYS = ["Region"]


def _full(spark, sf):
    return FB.full_request(FB.plan_requests(K._sales_series(spark, sf, _KEYS), _KEYS, 30), _KEYS)


# ---------------------------------------------------------------- ETS

@query("ets_grid_forecast", oracle=K._ets_sql(CLEAN_SALES, K._SALES_DAILY_REGION, "Region"))
def q_ets_grid_forecast(spark, sf):
    """The best of the 36 grid points that the search of `ets_forecast` starts from."""
    return rounded(FETS.ets(_full(spark, sf), _KEYS), K.R)


@query("ets_optimum_check", oracle=with_(CLEAN_SALES, _SERIES) + """
SELECT "Region", true AS converged, true AS below_grid, true AS no_step_lowers FROM plan""")
def q_ets_optimum_check(spark, sf):
    """The search behind `ets_forecast` ends in an optimum: below the best grid point, and no small step in any
    parameter or start state lowers the squared error."""
    o = FETS.optimality(_full(spark, sf), _KEYS)
    return o.select("Region", "converged", (F.col("sse") <= F.col("grid_sse")).alias("below_grid"),
                    (F.col("least_nearby") >= F.col("sse") * (1 - 1e-9)).alias("no_step_lowers"))


# ---------------------------------------------------------------- ARIMA

# The two candidates without moving-average terms, whose least squares SQL can write out: (1, 1, 0) with a
# seasonal difference and a lag of 7 days, and without. Lags and losses follow from the grid.
_SEASONAL_CID, _PLAIN_CID = 1, 3
_LOSS = max(r[7] for r in FAR.candidate_rows())
_AR = f"""filled AS (
  SELECT c."Region", c.ds, c.n, c.h, CAST(datediff('day', c.lo, c.ds) AS INTEGER) AS t, COALESCE(d.y, 0.0) AS y
  FROM (SELECT "Region", n, h, lo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ds FROM plan) c
  LEFT JOIN daily d ON d."Region" = c."Region" AND d.ds = c.ds),
lagged AS (SELECT *, lag(y, 1) OVER r AS y1, lag(y, 7) OVER r AS y7, lag(y, 8) OVER r AS y8 FROM filled WINDOW r AS (PARTITION BY "Region" ORDER BY t)),
w AS (SELECT "Region", n, {_PLAIN_CID} AS cid, t - 1 AS i, y - y1 AS w, 1 AS lost FROM lagged WHERE t >= 1
      UNION ALL SELECT "Region", n, {_SEASONAL_CID}, t - 8, y - y1 - y7 + y8, 8 FROM lagged WHERE t >= 8),
x AS (SELECT *, lag(w, 1) OVER r AS w1, CASE WHEN cid = {_SEASONAL_CID} THEN lag(w, 7) OVER r END AS w7
      FROM w WINDOW r AS (PARTITION BY "Region", cid ORDER BY i)),
g AS (SELECT "Region", cid, sum(w1 * w1) AS s11, sum(w1 * w7) AS s12, sum(w7 * w7) AS s22, sum(w * w1) AS r1, sum(w * w7) AS r2
      FROM x WHERE i >= CASE WHEN cid = {_SEASONAL_CID} THEN 7 ELSE 1 END GROUP BY 1, 2),
coef AS (SELECT "Region", cid, CASE WHEN cid = {_PLAIN_CID} THEN r1 / s11 ELSE (r1 * s22 - r2 * s12) / (s11 * s22 - s12 * s12) END AS a1,
                CASE WHEN cid = {_SEASONAL_CID} THEN (r2 * s11 - r1 * s12) / (s11 * s22 - s12 * s12) END AS a2 FROM g),
e AS (SELECT x."Region", x.cid, n, i, lost, w - a1 * COALESCE(w1, 0) - COALESCE(a2, 0) * COALESCE(w7, 0) AS e FROM x JOIN coef USING ("Region", cid)),
fit AS (SELECT "Region", cid, avg(e * e) FILTER (i >= CASE WHEN cid = {_SEASONAL_CID} THEN 7 ELSE 1 END) AS sigma2,
               (any_value(n) - {_LOSS}) * ln(sum(e * e) FILTER (i + lost >= {_LOSS}) / (any_value(n) - {_LOSS}))
               + 2 * CASE WHEN cid = {_SEASONAL_CID} THEN 3 ELSE 2 END AS aic FROM e GROUP BY 1, 2)"""


@query("arima_ar_fits", oracle=with_(CLEAN_SALES, _SERIES, _AR) + f"""
SELECT "Region", CAST(cid AS INTEGER) AS cid, {rnd_sql("a1")} AS a1, {rnd_sql("a2")} AS a2, {rnd_sql("sigma2")} AS sigma2, {rnd_sql("aic")} AS aic
FROM coef JOIN fit USING ("Region", cid)""")
def q_arima_ar_fits(spark, sf):
    """Coefficients, error variance and AIC of the purely autoregressive candidates, out of the whole grid."""
    fits = FAR.fit_candidates(_full(spark, sf), _KEYS).where(F.col("cid").isin(_SEASONAL_CID, _PLAIN_CID))
    return rounded(fits.select("Region", "cid", F.get("a", F.lit(0)).alias("a1"), F.get("a", F.lit(1)).alias("a2"), "sigma2", "aic"), K.R)


# y[t+1] from the values so far, newest last; an impulse instead of the series gives the psi weights
_NEXT = ("(a1 * (v[-1] - v[-2] - v[-8] + v[-9]) + a2 * (v[-7] - v[-8] - v[-14] + v[-15]) + v[-1] + v[-7] - v[-8])")


@query("arima_fixed_forecast", oracle=with_(CLEAN_SALES, _SERIES, _AR, f"""begin AS (
  SELECT "Region", hi, h, a1, a2, sigma2, list_concat([0.0::DOUBLE for k in range(16)], (SELECT list(y ORDER BY t) FROM filled f WHERE f."Region" = p."Region")) AS v,
         list_append([0.0::DOUBLE for k in range(16)], 1.0::DOUBLE) AS psi
  FROM plan p JOIN coef USING ("Region") JOIN fit USING ("Region", cid) WHERE cid = {_SEASONAL_CID}),
walk AS (
  SELECT "Region", hi, h, a1, a2, sigma2, 0 AS step, list_slice(v, -16, -1) AS v, psi, CAST(0.0 AS DOUBLE) AS total FROM begin
  UNION ALL
  SELECT "Region", hi, h, a1, a2, sigma2, step + 1, list_append(v, {_NEXT}), list_append(psi, {_NEXT.replace("v[", "psi[")}),
         total + psi[-1] * psi[-1] FROM walk WHERE step < h)""").replace("WITH ", "WITH RECURSIVE ", 1) + f"""
SELECT "Region", CAST(step AS INTEGER) AS step, CAST(hi + step AS DATE) AS ds, {rnd_sql("v[-1]")} AS forecast,
       {rnd_sql("v[-1] - 1.96 * sqrt(sigma2 * total)")} AS lower, {rnd_sql("v[-1] + 1.96 * sqrt(sigma2 * total)")} AS upper
FROM walk WHERE step > 0""")
def q_arima_fixed_forecast(spark, sf):
    """M5: forecast and interval of one configuration, fitted per region."""
    config = spark.createDataFrame([(_SEASONAL_CID,)], "cid int")
    req = _full(spark, sf)
    config = req.select(*_KEYS).distinct().join(F.broadcast(config))  # one row
    return rounded(FAR.arima(req, _KEYS, config).select("Region", "step", "ds", "forecast", "lower", "upper"), K.R)


# ---------------------------------------------------------------- model store and documents

_STORED = ("sarimax", "ets", "forest", "boosting", "average")


@query("stored_forecast_check", oracle=with_(CLEAN_SALES, _SERIES) + """
SELECT "Region", model, h AS steps, CAST(hi + 1 AS DATE) AS first_day, true AS same FROM plan,
  (VALUES ('SARIMAX'), ('Exponential Smoothing'), ('Random Forest'), ('Gradient Boosting'), ('Moving Average')) m(model)""")
def q_stored_forecast_check(spark, sf):
    """Every model fitted per region, stored, read back and forecast again: equal to its direct forecast.

    The trees are smaller here than in `forest_forecast` and `boosting_forecast`: what is checked is the store."""
    req = _full(spark, sf).persist()
    sizes = {"forest": {"num_trees": 20}, "boosting": {"max_iter": 20}}
    path = FS.scratch_path(spark, "models")
    direct = []
    for name in _STORED:
        fitted = ST.fit(name, req, _KEYS, **sizes.get(name, {}))
        fitted = ST.Fitted(fitted.states.checkpoint(), fitted.nodes)
        ST.save(fitted, f"{path}/{name}")
        again = ST.forecast_stored(spark, f"{path}/{name}", _KEYS)
        both = ST.forecast_states(fitted, _KEYS).join(
            again.select(*_KEYS, "step", *[F.col(c).alias(f"{c}_2") for c in ("ds", "forecast", "lower", "upper")]), [*_KEYS, "step"], "full")
        near = F.every(*[F.coalesce((F.col("ds") == F.col("ds_2")) & sum(
            F.abs(F.col(c) - F.col(f"{c}_2")) for c in ("forecast", "lower", "upper")).__le__(
            1e-9 * F.greatest(F.lit(1.0), F.abs("forecast"))), F.lit(False))])
        direct.append(both.groupBy(*_KEYS, "model").agg(F.count("forecast").cast("int").alias("steps"), F.min("ds").alias("first_day"), near.alias("same")))
    out = direct[0]
    for more in direct[1:]:
        out = out.unionByName(more)
    out = out.checkpoint()
    req.unpersist()
    return out


def _backtest_scores(spark, sf):
    plan = FB.plan_requests(K._sales_series(spark, sf, _KEYS), _KEYS, 30)
    rows = FMA.moving_average(FB.train_request(plan, _KEYS), _KEYS)
    return FB.score(rows, plan.where(F.col("split") == "test"), _KEYS)


@query("report_document_comparison", oracle=K._ma_sql(CLEAN_SALES, K._SALES_DAILY_REGION, ["Region"], True))
def q_report_document_comparison(spark, sf):
    """The model comparison in the JSON document, read back."""
    clean, roles = C.clean_sales(TB.sales(spark, sf))
    docs = RP.analysis_document(clean, roles, _KEYS, comparison=_backtest_scores(spark, sf))
    return rounded(RP.comparison_from_document(docs, _KEYS).select("Region", "model", "mae", "rmse", K.rnd_sig(F.col("mape")).alias("mape")), K.R)


# ---------------------------------------------------------------- stored sessions and users

@query("purge_stored", oracle=with_(K._SESSIONS_SQL) + f"""
SELECT CAST(expires_at AS DATE) AS expiry_day,
       CASE WHEN CAST(expires_at AS DATE) < DATE '{K.AS_OF[:10]}' THEN 'gone' WHEN CAST(expires_at AS DATE) = DATE '{K.AS_OF[:10]}' THEN 'rewritten'
            ELSE 'unchanged' END AS files,
       count(*) FILTER (expires_at >= TIMESTAMP '{K.AS_OF}') AS n_kept
FROM sessions_v GROUP BY 1, 2
HAVING CAST(expires_at AS DATE) <> DATE '{K.AS_OF[:10]}' OR '{K.AS_OF[11:]}' > '00:00:00' OR count(*) FILTER (expires_at >= TIMESTAMP '{K.AS_OF}') > 0""")
def q_purge_stored(spark, sf):
    """The stored sessions purged as of a day: what became of each day's files, and the sessions left."""
    path = FS.scratch_path(spark, "sessions")
    US.store_sessions(TB.sessions(spark, sf), path)
    day = F.regexp_extract("path", "expiry_day=([0-9-]+)", 1).cast("date")
    before = FS.listed_files(spark, path, ".parquet").select(day.alias("expiry_day"), "path", "length", "modified").checkpoint()
    US.purge_stored(spark, path, K.AS_OF)
    after = FS.listed_files(spark, path, ".parquet").select("path", "length", "modified", F.lit(True).alias("there"))
    same = before.join(after, ["path", "length", "modified"], "left").groupBy("expiry_day").agg(
        F.every(F.coalesce("there", F.lit(False))).alias("same"))
    left = US.stored_sessions(spark, path).groupBy("expiry_day").agg(F.count(F.lit(1)).alias("n_kept"))
    became = F.when(F.col("n_kept").isNull(), "gone").when(F.col("same"), "unchanged").otherwise("rewritten")
    return same.join(left, "expiry_day", "left").select("expiry_day", became.alias("files"), F.coalesce("n_kept", F.lit(0)).alias("n_kept"))


@query("session_lookup", oracle=with_(K._USERS_SQL, K._SESSIONS_SQL) + """
SELECT s.token, s.user_id, u.email, u.role, s.expires_at FROM sessions_v s JOIN users_v u ON u.id = s.user_id WHERE s.token = 'tok-100'""")
def q_session_lookup(spark, sf):
    """One token looked up in the stored sessions, at a time when it is valid."""
    path = FS.scratch_path(spark, "sessions")
    US.store_sessions(TB.sessions(spark, sf), path)
    return US.session_for_token(US.stored_sessions(spark, path), TB.users(spark, sf), "tok-100", "2024-01-01 00:00:00")


@query("user_lookup", oracle=with_(K._USERS_SQL) + """
SELECT id, email, role FROM users_v WHERE email = 'customer.000000077@example.com'""")
def q_user_lookup(spark, sf):
    """One email, in other case and with blanks, looked up in the stored users."""
    path = FS.scratch_path(spark, "users")
    US.store_users(TB.users(spark, sf), path)
    return US.user_for_email(spark.read.parquet(path), " Customer.000000077@Example.com ")


# ---------------------------------------------------------------- files and roles

@query("ingest_ledger", oracle=with_(RAW_ORDERS) + """
SELECT CAST(5 AS BIGINT) AS n_files, CAST(1 AS BIGINT) AS n_empty, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_taken_again FROM raw_orders""")
def q_ingest_ledger(spark, sf):
    """Four CSV files and one without rows, taken into a ledger, and taken again."""
    folder, book = FS.scratch_path(spark, "uploads"), FS.scratch_path(spark, "ledger")
    raw = TB.raw_orders(spark, sf)
    raw.repartition(4).write.option("header", True).csv(folder)
    raw.limit(0).coalesce(1).write.mode("append").option("header", True).csv(folder)
    first = FS.take_files(spark, folder, book)
    taken = first.agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("rows") == 0).alias("n_empty"), F.sum("rows").alias("n_rows"))
    return taken.withColumn("n_taken_again", F.lit(FS.take_files(spark, folder, book).count()).cast("long"))


_DETECTED = {"orders": ("o_orderdate", "o_totalprice"), "lineitem": ("l_shipdate", None), "events": (None, "value")}


@query("detected_role_totals", oracle=" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, {repr(d) if d else 'CAST(NULL AS VARCHAR)'} AS date_col, {repr(r) if r else 'CAST(NULL AS VARCHAR)'} AS revenue_col, "
    f"count(*) AS n_rows, {f'count({d})' if d else 'CAST(0 AS BIGINT)'} AS n_dates, {f'count({r})' if r else 'CAST(0 AS BIGINT)'} AS n_revenues FROM {t}"
    for t, (d, r) in _DETECTED.items()))
def q_detected_role_totals(spark, sf):
    """J4 on tables: the columns that the keywords find in each table, and how many of its rows they fill."""
    out = None
    for name in TB.TABLES:
        df = TB.table(spark, sf, name)
        roles = M.detect_roles(df)
        if roles.date_col or roles.revenue_col:
            part = df.agg(F.count(F.lit(1)).alias("n_rows"), *[
                (F.count(c) if c else F.lit(0).cast("long")).alias(n) for c, n in ((roles.date_col, "n_dates"), (roles.revenue_col, "n_revenues"))])
            part = part.select(F.lit(name).alias("table_name"), F.lit(roles.date_col).cast("string").alias("date_col"),
                               F.lit(roles.revenue_col).cast("string").alias("revenue_col"), "n_rows", "n_dates", "n_revenues")
            out = part if out is None else out.unionByName(part)
    return out
