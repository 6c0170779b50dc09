"""IQR anomalies on the gap-filled daily series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import drop_seg, seg_keys
from . import series as S

# Minimum series length, IQR fence multiplier, anomalies reported.
MIN_DAYS = 10
IQR_K = 1.5
REPORTED = 5


def _quantile(sorted_ys: F.Column, n: F.Column, p: float) -> F.Column:
    """Linear-interpolation quantile of a sorted array (pandas / `quantile_cont` rule)."""
    pos = (n - 1) * p
    i = F.floor(pos).cast("int")
    frac = pos - i
    a = F.element_at(sorted_ys, i + 1)
    b = F.element_at(sorted_ys, F.least(i + 2, n))
    return a + frac * (b - a)


def detect_anomalies(clean: DataFrame, keys: Sequence[str] = (), first_only: bool = True) -> DataFrame:
    """Days strictly outside [Q1 − 1.5·IQR, Q3 + 1.5·IQR]; segments under 10 days have none.

    `first_only` keeps the first five by date per segment (what the reference reports);
    otherwise every flagged day is returned with its rank.
    """
    user_keys = list(keys)
    df, k = seg_keys(clean, user_keys)
    return drop_seg(anomalies_from_daily(S.daily(df, k), k, first_only))


def _flags(days: F.Column, ys: F.Column, n: F.Column):
    """Fences from the sorted gap-filled values and the flagged (day, value) pairs in date order."""
    srt = F.array_sort(ys)
    q1, q3 = _quantile(srt, n, 0.25), _quantile(srt, n, 0.75)
    lower, upper = q1 - IQR_K * (q3 - q1), q3 + IQR_K * (q3 - q1)
    # the fences travel inside the zipped array: a lambda that referred to them directly
    # would have the optimizer inline the sort into every element's evaluation
    zipped = F.arrays_zip(days.alias("days"), ys.alias("ys"), F.array_repeat(lower, n).alias("lo"),
                          F.array_repeat(upper, n).alias("hi"))
    flagged = F.filter(zipped, lambda z: (z["ys"] < z["lo"]) | (z["ys"] > z["hi"]))
    return flagged, upper


def reported_count(day_map: F.Column, first_ds: F.Column, last_ds: F.Column) -> F.Column:
    """Number of reported anomalies (≤ 5) from a segment's day -> value map column — a
    column expression, so it rides along the aggregation that already holds the day rows."""
    days, ys = S.calendar_values(day_map, first_ds, last_ds)
    flagged, _ = _flags(days, ys, F.size(days))
    return F.when(F.size(days) >= MIN_DAYS, F.least(F.size(flagged), F.lit(REPORTED))).otherwise(F.lit(0))


def anomalies_from_daily(daily: DataFrame, k: list[str], first_only: bool = True) -> DataFrame:
    """R1 on a daily (not gap-filled) frame `(k…, ds, y)`; keeps the key columns as given.

    Works on each segment's gap-filled calendar arrays (bounded by its date span): exact
    quartiles from the sorted array, fences, flagged days in date order — one row per
    segment until the final explode, so the daily rows are read once.
    """
    cal = S.segment_calendar(daily, k).where(F.col("n_days") >= MIN_DAYS)
    flagged, upper = _flags(F.col("days"), F.col("ys"), F.col("n_days"))
    if first_only:
        flagged = F.slice(flagged, 1, REPORTED)
    out = cal.select(*k, F.posexplode(flagged).alias("pos", "z"))
    return out.select(*k, F.date_format(F.col("z.days"), "yyyy-MM-dd").alias("date"), F.col("z.ys").alias("value"),
                      F.when(F.col("z.ys") > F.col("z.hi"), "high").otherwise("low").alias("type"),
                      (F.col("pos") + 1).alias("rank"))
