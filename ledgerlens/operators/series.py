"""Daily series per segment: aggregation, calendar gap-fill, positions and lag features
(A5, J1, M1, W1–W11).

A series is `(keys…, ds date, y double)`. Windows only ever run over *daily* rows of one
segment (bounded by the calendar span), never over raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import to_day
from ..functions.numeric import strict_number, zero_fill


def daily(df: DataFrame, keys: Sequence[str] = (), date_col: str = "Date",
          value_col: str = "Revenue") -> DataFrame:
    """A5: sum of the value per segment and day (partial aggregation before the shuffle)."""
    keys = list(keys)
    return (df.groupBy(*keys, F.col(date_col).alias("ds"))
            .agg(F.sum(value_col).alias("y")))


def calendar_values(day_map: F.Column, first_ds: F.Column, last_ds: F.Column) -> tuple[F.Column, F.Column]:
    """The calendar days first..last and their values from a day -> value map, gaps 0.0.

    `map_zip_with` against a zero-filled calendar map merges by hashed key (linear); a
    per-day `element_at` lookup would scan the map for every day (quadratic in the span).
    The result keeps the calendar map's key order.
    """
    days = F.sequence(first_ds, last_ds, F.expr("INTERVAL 1 DAY"))
    zeros = F.map_from_arrays(days, F.array_repeat(F.lit(0.0), F.size(days)))
    merged = F.map_zip_with(zeros, day_map, lambda k, zero, v: F.coalesce(v, zero))
    return days, F.map_values(merged)


def segment_calendar(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per segment: first/last day, length, the gap-filled days and values as arrays.

    The daily sums of a segment fold into a map (at most one entry per calendar day, so the
    group is bounded by the date span, not by the data) and the calendar is read back from
    it — one pass over the input, no self-join.
    """
    keys = list(keys)
    per = series.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("ds", "y"))).alias("__m"),
        F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"))
    days, ys = calendar_values(F.col("__m"), F.col("first_ds"), F.col("last_ds"))
    return (per.select(*keys, "first_ds", "last_ds", days.alias("days"), ys.alias("ys"))
            .withColumn("n_days", F.size("days")))


def gap_fill(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per calendar day from the first to the last day of each segment, gaps = 0.0.

    Adds `t` (0-based day position) and `n_days` (series length).
    """
    keys = list(keys)
    cal = segment_calendar(series, keys)
    return cal.select(*keys, "n_days", F.posexplode(F.arrays_zip("days", "ys")).alias("t", "z")) \
        .select(*keys, F.col("z.days").alias("ds"), F.col("z.ys").alias("y"), "t", "n_days")


def prepare_daily_series(df: DataFrame, keys: Sequence[str] = (), date_col: str = "Date",
                         value_col: str = "Revenue") -> DataFrame:
    """M1: coerce date and value, drop bad dates, sum per day, gap-fill."""
    types = {f.name: f.dataType for f in df.schema.fields}
    v = F.col(value_col)
    value = v.cast("double") if isinstance(types[value_col], T.NumericType) else strict_number(v)
    staged = (df.select(*keys, to_day(F.col(date_col), types[date_col]).alias("__d"),
                        zero_fill(value).alias("__v"))
              .where(F.col("__d").isNotNull()))
    return gap_fill(daily(staged, keys, "__d", "__v"), keys)


def supervised_features(series: DataFrame, keys: Sequence[str] = (), n_lags: int = 21) -> DataFrame:
    """M7: lags 1..n_lags, trailing mean/std over 7 and 14 previous days, calendar features.

    Rows without a complete lag window are dropped (the first max(n_lags, 14) days).
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("ds")
    cols = {f"lag_{k}": F.lag("y", k).over(w) for k in range(1, n_lags + 1)}
    for win in (7, 14):
        frame = w.rowsBetween(-win, -1)
        cols[f"roll_mean_{win}"] = F.when(F.count("y").over(frame) == win, F.avg("y").over(frame))
    for win in (7, 14):
        frame = w.rowsBetween(-win, -1)
        cols[f"roll_std_{win}"] = F.when(F.count("y").over(frame) == win,
                                         F.stddev_samp("y").over(frame))
    cols["dayofweek"] = F.weekday("ds")
    cols["month"] = F.month("ds")
    cols["day"] = F.dayofmonth("ds")
    cols["__rn"] = F.row_number().over(w)
    out = series.select(*keys, "ds", "y", *[e.alias(n) for n, e in cols.items()])
    return out.where(F.col("__rn") > max(n_lags, 14)).drop("__rn")
