"""M3: moving-average forecast, the safe fallback — pure window/aggregate SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...plans.joins import drop_seg, seg_keys
from .base import MOVING_AVERAGE, band

# Fixed value: trailing window length.
WINDOW = 7


def average_state(request: DataFrame, keys: Sequence[str], window: int = WINDOW) -> DataFrame:
    """keys…, level, sigma, last_ds, h: the mean of the last w = min(window, n) days, and the population std of y
    minus its trailing mean (partial windows allowed).

    With n < window the trailing window is the expanding mean, so the frame bounds stay
    constant and every window runs inside one segment.
    """
    w = Window.partitionBy(*keys).orderBy("t")
    rolling = F.when(F.col("n") >= window, F.avg("y").over(w.rowsBetween(-(window - 1), 0))) \
        .otherwise(F.avg("y").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = request.withColumn("__rm", rolling)
    # one aggregate gives level, σ, last day and horizon, so the request is read once
    return r.groupBy(*keys).agg(
        F.avg(F.when(F.col("t") >= F.col("n") - F.least(F.lit(window), F.col("n")), F.col("y"))).alias("level"),
        F.coalesce(F.stddev_pop(F.col("y") - F.col("__rm")), F.lit(0.0)).alias("sigma"),
        F.max("ds").alias("last_ds"), F.first("h").alias("h"))


def steps_of(states: DataFrame, keep: Sequence[str]) -> DataFrame:
    """keep…, step, ds, forecast, lower, upper: the level repeated h times, the band clipped at 0."""
    out = states.select(*keep, "level", "sigma", "last_ds", F.explode(F.sequence(F.lit(1), F.col("h"))).alias("step")) \
        .withColumn("ds", F.date_add("last_ds", F.col("step")))
    lo, hi = band(F.col("level"), F.col("sigma"))
    return out.select(*keep, "step", "ds", F.col("level").alias("forecast"), lo.alias("lower"), hi.alias("upper"))


def moving_average(request: DataFrame, keys: Sequence[str] = (), window: int = WINDOW,
                   model_name: str = MOVING_AVERAGE) -> DataFrame:
    """The forecast rows of `average_state`."""
    request, k = seg_keys(request, list(keys))
    rows = steps_of(average_state(request, k, window), k)
    return drop_seg(rows.select(*k, F.lit(model_name).alias("model"), "step", "ds", "forecast", "lower", "upper"))
