"""M13/M14 + A22: backtest every model per segment, pick the least MAPE, refit the winner on
the whole series, and report the comparison, the forecast rows and the payload totals.

Segments shorter than 20 days skip the backtest and get the moving average on the full
series. A model that fails for a segment is absent from that segment's comparison alone, and `failures`
says why (a Spark job that fails is raised); a segment with no successful backtest falls back to the moving average (on the full
series — documented deviation, the reference mixes train and full series there).
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...plans.joins import drop_seg, seg_keys
from ...session import ensure_checkpoint_dir
from . import arima as AR
from . import store as ST
from . import trees as TR
from .base import (BOOSTING, ETS, FOREST, MODEL_ORDER, MOVING_AVERAGE, SARIMAX, Z95, full_request,
                   plan_requests, score, train_request)

ALL_MODELS = ("sarimax", "ets", "forest", "boosting")
_NAMES = {"sarimax": SARIMAX, "ets": ETS, "forest": FOREST, "boosting": BOOSTING}
# Payload messages.
MSG_SHORT = "Not enough data. Used moving average fallback."
MSG_ALL_FAILED = "All models failed. Used moving average fallback."
MSG_BEST = "Best model selected: {name}"
MSG_TOO_FEW = "Not enough dates for forecasting."
NOT_ENOUGH = "Not enough data"
# Own texts: why a model fails for one segment.
ERR_VALUES = "the series holds values that are not finite"
ERR_NO_FIT = "the model could not be fitted"
ERR_STEPS = "the forecast has too few steps"
ERR_FORECAST = "the forecast is not finite"
MIN_DAYS = 5
HISTORY_TAIL = 120


@dataclass
class ForecastResult:
    comparison: DataFrame        # keys…, model, mae, rmse, mape, extra
    forecast: DataFrame | None   # keys…, best_model, step, ds, forecast, lower, upper
    summary: DataFrame | None    # keys…, best_model, horizon, training_end, forecast_sum, forecast_average, message
    failures: DataFrame | None = None  # keys…, model, error: why a model is missing from a segment's comparison or refit


def _judged(rows: DataFrame, request: DataFrame, k: list[str], model: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the segments that `model` succeeded for, failures: keys…, model, error).

    A segment fails alone: it has no forecast, fewer steps than asked for, or values that are not finite."""
    asked = request.groupBy(*k).agg(F.first("h").alias("__h"), F.every(F.abs("y") < float("inf")).alias("__usable"))
    finite = F.every(*[F.coalesce(sum(F.abs(c) for c in map(F.col, ("forecast", "lower", "upper"))) < float("inf"), F.lit(False))])
    got = rows.groupBy(*k).agg(F.count(F.lit(1)).alias("__steps"), finite.alias("__finite"))
    error = (F.when(~F.col("__usable"), F.lit(ERR_VALUES)).when(F.col("__steps").isNull(), F.lit(ERR_NO_FIT))
             .when(F.col("__steps") < F.col("__h"), F.lit(ERR_STEPS)).when(~F.col("__finite"), F.lit(ERR_FORECAST)))
    failed = (asked.join(got, k, "left").select(*k, F.lit(model).alias("model"), error.alias("error"))
              .where(F.col("error").isNotNull()))
    return rows.join(failed.select(*k), k, "left_anti"), failed


def compare_forecasting_models(series: DataFrame, keys: Sequence[str] = (), horizon: int = 30,
                               models: Sequence[str] = ALL_MODELS,
                               tree_params: dict | None = None, refit: bool = True,
                               save_to: str | None = None) -> ForecastResult:
    """`refit=False` gives the comparison alone, without a fit on the whole series; `save_to`
    names a shared folder for the winners (M14): refitted tree models, `bundle` and a store of states (`store`),
    each under the run's identifier.

    `series` is a gap-filled daily frame `(keys…, ds, y)` (see `series.prepare_daily_series`)."""
    user_keys = list(keys)
    ensure_checkpoint_dir(series.sparkSession)
    tree_params = tree_params or {}
    # P20: rows without a usable value are dropped before modelling
    usable = F.col("y").isNotNull() & ~F.isnan("y")
    series, k = seg_keys(series.select(*user_keys, "ds", "y").where(usable), user_keys)
    # a row a calendar day: written, so that models, payload and totals pass over the raw rows once
    plan_all = plan_requests(series, k, horizon).checkpoint()
    # Fewer than five calendar days -> no forecast, only a payload row
    plan = plan_all.where(F.col("n") >= MIN_DAYS)
    too_few = (plan_all.where(F.col("n") < MIN_DAYS).groupBy(*k)
               .agg(F.max("ds").alias("training_end"))
               .select(*k, F.lit(NOT_ENOUGH).alias("best_model"), F.lit(0).alias("horizon"), "training_end",
                       F.lit(0.0).alias("forecast_sum"), F.lit(0.0).alias("forecast_average"),
                       F.lit(MSG_TOO_FEW).alias("message")))
    train = train_request(plan, k)
    test = plan.where(F.col("split") == "test").select(*k, "ds", "y")

    # the models are independent jobs: submit them from parallel driver threads so the sequential boosting
    # rounds overlap with the other fits. A job that fails is raised; a segment that fails is told in the result.
    def backtest(model: str) -> tuple[DataFrame, DataFrame]:
        fitted = ST.fit(model, train, k, **tree_params.get(model, {}))
        return _judged(ST.forecast_states(fitted, k).checkpoint(), train, k, _NAMES[model])

    with ThreadPoolExecutor(max_workers=len(models)) as pool:
        tests = list(pool.map(backtest, models))
    bt, failed = _all_of([rows for rows, _ in tests]), _all_of([failures for _, failures in tests])
    failed = failed.checkpoint()
    scores = score(bt.select(*k, "model", "ds", "forecast"), test, k)
    extra = bt.groupBy(*k, "model").agg(F.first("extra").alias("extra"))
    rank = F.array_position(F.array(*[F.lit(m) for m in MODEL_ORDER]), F.col("model"))
    comparison = scores.join(extra, k + ["model"]).withColumn("model_rank", rank).checkpoint()
    best = comparison.groupBy(*k).agg(F.min_by("model", F.struct("mape", "model_rank")).alias("best_model"),
                                      F.min_by("extra", F.struct("mape", "model_rank")).alias("extra"))
    result = drop_seg(comparison.select(*k, "model", "mae", "rmse", "mape", "extra"))
    if not refit:
        return ForecastResult(result, None, None, drop_seg(failed))

    full = full_request(plan, k)
    winners = {r.best_model for r in best.select("best_model").distinct().collect()}  # at most the models

    run_id = ST.new_run()
    folder = f"{save_to.rstrip('/')}/models/{run_id}" if save_to else None

    def refit_one(m: str) -> tuple[ST.Fitted, DataFrame, DataFrame]:
        chosen = best.where(F.col("best_model") == _NAMES[m])
        req = full.join(chosen.select(*k), k, "left_semi")
        config = lags = None
        if m == "sarimax":
            config = chosen.join(_cid_table(series.sparkSession), "extra").select(*k, "cid")
        elif m in ("forest", "boosting"):  # the lags of the backtest
            lags = chosen.select(*k, F.regexp_extract("extra", r"lags=(\d+)", 1).cast("int").alias("lags"))
        fitted = ST.fit(m, req, k, config, lags, folder, **tree_params.get(m, {}))
        fitted = ST.Fitted(fitted.states.checkpoint(), fitted.nodes)
        rows, failures = _judged(ST.forecast_states(fitted, k).checkpoint(), req, k, _NAMES[m])
        return ST.Fitted(fitted.states.join(failures.select(*k), k, "left_anti"), fitted.nodes), rows, failures

    with ThreadPoolExecutor(max_workers=len(models)) as pool:
        refits = list(pool.map(refit_one, [m for m in models if _NAMES[m] in winners]))
    # moving average: short series, segments whose backtests all failed, and failed refits
    columns = [*k, F.col("model").alias("best_model"), "step", "ds", "forecast", "lower", "upper"]
    done = [rows.select(*columns) for _, rows, _ in refits]
    ma_req = full.join(_all_of([rows.select(*k) for rows in done]).distinct(), k, "left_anti") if done else full
    average = ST.fit("average", ma_req, k)
    forecast = _all_of([*done, ST.forecast_states(average, k).select(*columns)])
    failed = _all_of([failed, *[failures for _, _, failures in refits]])

    info = plan.groupBy(*k).agg(F.first("h").alias("horizon"), F.max("ds").alias("training_end"),
                                F.first("n").alias("n"))
    had_backtest = comparison.select(*k).distinct().withColumn("__bt", F.lit(True))
    totals = forecast.groupBy(*k, "best_model").agg(F.sum("forecast").alias("forecast_sum"),
                                                   F.avg("forecast").alias("forecast_average"))
    msg = (F.when(F.col("n") < 20, F.lit(MSG_SHORT))
           .when((F.col("best_model") == MOVING_AVERAGE) & F.col("__bt").isNull(), F.lit(MSG_ALL_FAILED))
           .otherwise(F.concat(F.lit(MSG_BEST.split("{")[0]), F.col("best_model"))))
    summary = (totals.join(info, k).join(had_backtest, k, "left")
               .select(*k, "best_model", "horizon", "training_end", "forecast_sum", "forecast_average",
                       msg.alias("message"))
               .unionByName(too_few))
    if save_to:
        # one bundle row a segment, read by people, and the states that forecast again
        bundle = _bundle(plan, forecast, best, info, k, folder)
        bundle.withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(f"{save_to.rstrip('/')}/bundle")
        ST.save(ST.together([fitted for fitted, _, _ in refits] + [average]), save_to, run_id=run_id)
    return ForecastResult(result, drop_seg(forecast), drop_seg(summary), drop_seg(failed))


def _bundle(plan: DataFrame, forecast: DataFrame, best: DataFrame, info: DataFrame, k: list[str], folder: str) -> DataFrame:
    """One row a segment: best_model, config (its parameters as text), horizon, training_end,
    feature_columns and model_path (tree models), history_tail (the last HISTORY_TAIL values),
    residual_std (from the first step's band) and saved_at."""
    tail = (plan.where(F.col("t") >= F.col("n") - HISTORY_TAIL).groupBy(*k)
            .agg(F.sort_array(F.collect_list(F.struct("t", "y"))).alias("points"))
            .select(*k, F.transform("points", lambda p: p["y"]).alias("history_tail")))
    first = forecast.where("step = 1").select(*k, "best_model", ((F.col("upper") - F.col("forecast")) / Z95).alias("residual_std"))
    lags = F.regexp_extract("extra", r"lags=(\d+)", 1)
    kind = F.when(F.col("best_model") == FOREST, "forest").when(F.col("best_model") == BOOSTING, "boosting")
    numbered = F.transform(F.sequence(F.lit(1), lags.try_cast("int")), lambda i: F.concat(F.lit("lag_"), i.cast("string")))
    others = F.array(*[F.lit(c) for c in TR.feature_columns(0)])
    return (first.join(best.select(*k, "extra"), k, "left").join(info, k).join(tail, k)
            .select(*k, "best_model", F.col("extra").alias("config"), "horizon", "training_end", "history_tail", "residual_std",
                    F.when(kind.isNotNull(), F.concat(numbered, others)).alias("feature_columns"),
                    F.when(kind.isNotNull(), F.concat(F.lit(folder.rstrip("/") + "/"), kind, F.lit("-lags-"), lags)).alias("model_path"),
                    F.current_timestamp().alias("saved_at")))


def _all_of(parts: Sequence[DataFrame]) -> DataFrame:
    """The union of frames of the same columns."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def forecast_overlay(series: DataFrame, forecast: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Actual series and forecast with its band as one long frame with a `series` column."""
    keys = list(keys)
    actual = series.select(*keys, "ds", F.col("y").alias("value")).withColumn("series", F.lit("actual"))
    fc = forecast.select(*keys, "ds", F.col("forecast").alias("value"), "lower", "upper") \
        .withColumn("series", F.lit("forecast"))
    return actual.unionByName(fc, allowMissingColumns=True)


def write_bundle(result: ForecastResult, path: str, keys: Sequence[str] = ()) -> None:
    """Append the bundle metadata (one JSON line per segment) to a shared folder."""
    model_bundle(result, keys).write.mode("append").json(path)


def _cid_table(spark) -> DataFrame:
    rows = [(cid, AR.config_text(o, so)) for cid, o, so in AR.CANDIDATES]
    return spark.createDataFrame(rows, "cid int, extra string")


def model_bundle(result: ForecastResult, keys: Sequence[str] = ()) -> DataFrame:
    """M14/S8 metadata per segment: saved_at, best_model, horizon, training_end (as JSON text)."""
    keys = list(keys)
    s = result.summary
    return s.select(*keys, F.to_json(F.struct(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("saved_at"),
        "best_model", "horizon", F.date_format("training_end", "yyyy-MM-dd'T'00:00:00").alias("training_end")))
        .alias("meta"))


__all__ = ["compare_forecasting_models", "ForecastResult", "model_bundle", "write_bundle",
           "forecast_overlay"]
