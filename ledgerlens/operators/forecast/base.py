"""Shared forecast plumbing: horizon clamp, train/hold-out split, future dates, metrics.

Every model takes a *request* frame — the gap-filled training rows `(keys…, ds, y, t)`
plus per-segment `n` (training length) and `h` (steps to forecast) — and returns
`(keys…, model, step, ds, forecast, lower, upper)`, so backtests, refits and the
comparison are plain unions and joins on `(keys…, ds)`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Horizon floor and divisor, short-series threshold, MAPE floor, band width.
MIN_HORIZON = 3
HORIZON_DIVISOR = 4
SHORT_SERIES = 20
MAPE_FLOOR = 1e-6
Z95 = 1.96

# Model names and their order (ties in MAPE go to the earlier model).
SARIMAX = "SARIMAX"
ETS = "Exponential Smoothing"
FOREST = "Random Forest"
BOOSTING = "Gradient Boosting"
MOVING_AVERAGE = "Moving Average"
MODEL_ORDER = [SARIMAX, ETS, FOREST, BOOSTING]


# Tasks a core for frames of a row a segment (and candidate), and how many are asked for at least.
TASKS_A_CORE = 3
LEAST_TASKS = 24


def fit_partitions(spark: SparkSession) -> int:
    """Partitions of frames with few bytes and much to compute a row, which adaptive execution must not coalesce.

    They follow the cores. The shuffle setting follows the raw rows: taken for these frames it makes tasks without
    a row, and the unions and joins of the models multiply them."""
    cores = spark.sparkContext.defaultParallelism
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(LEAST_TASKS, TASKS_A_CORE * cores))


def clamp_horizon(n: F.Column, horizon: int) -> F.Column:
    """M2: max(3, min(horizon, max(3, n // 4)))."""
    quarter = F.floor(n / HORIZON_DIVISOR).cast("int")
    return F.greatest(F.lit(MIN_HORIZON),
                      F.least(F.lit(horizon), F.greatest(F.lit(MIN_HORIZON), quarter))).cast("int")


def with_length(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Series length and 0-based day position per segment (gap-filled input)."""
    keys = list(keys)
    w = Window.partitionBy(*keys)
    return (series.withColumn("n", F.count(F.lit(1)).over(w).cast("int"))
            .withColumn("t", F.row_number().over(w.orderBy("ds")) - 1))


def plan_requests(series: DataFrame, keys: Sequence[str], horizon: int) -> DataFrame:
    """Adds `n`, `t`, `h` (clamped horizon), `n_train` and `split` (train / test / short)."""
    s = with_length(series, keys)
    s = s.withColumn("h", clamp_horizon(F.col("n"), horizon))
    s = s.withColumn("n_train", F.col("n") - F.col("h"))
    split = (F.when(F.col("n") < SHORT_SERIES, F.lit("short"))
             .when(F.col("t") < F.col("n_train"), F.lit("train")).otherwise(F.lit("test")))
    return s.withColumn("split", split)


def train_request(plan: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Backtest request: the training rows, `n` = training length, `h` = hold-out length."""
    return (plan.where(F.col("split") == "train")
            .select(*keys, "ds", "y", "t", F.col("n_train").alias("n"), "h"))


def full_request(plan: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Refit request: the whole series."""
    return plan.select(*keys, "ds", "y", "t", "n", "h")


def band(forecast: F.Column, sigma: F.Column, clip: bool = True) -> tuple[F.Column, F.Column]:
    lo, hi = forecast - Z95 * sigma, forecast + Z95 * sigma
    if clip:
        return F.greatest(lo, F.lit(0.0)), F.greatest(hi, F.lit(0.0))
    return lo, hi


def score(forecast: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """MAE, RMSE and MAPE (|actual| floored at 1e-6) per segment and model."""
    keys = list(keys)
    j = forecast.join(actual.select(*keys, "ds", F.col("y").alias("actual")), keys + ["ds"])
    e = F.col("actual") - F.col("forecast")
    return j.groupBy(*keys, "model").agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.abs(e / F.greatest(F.abs(F.col("actual")), F.lit(MAPE_FLOOR)))) * 100).alias("mape"))
