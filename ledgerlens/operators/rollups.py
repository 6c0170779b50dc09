"""Dashboard rollups.

Every rollup is a hash aggregate on `(keys…, dimension)` with map-side partial
aggregation; fixed domains (weekdays, months) are generated per segment with `explode`
of a literal array, never by joining against the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import MONTHS, QUARTERS, WEEKDAYS
from ..functions.numeric import strict_number
from ..plans.joins import drop_seg, seg_keys
from ..plans.topk import group_top_k
from .kpi import PROFIT_RATIO

CATEGORY_ORDERS = {"Month": MONTHS, "Quarter": QUARTERS, "Day": WEEKDAYS}
# Top-k size of the product panel and the marker size range of the 3-D view.
TOP_PRODUCTS = 6
MARKER_MIN, MARKER_MAX = 8.0, 22.0


def order_key(df: DataFrame, x: str) -> F.Column:
    """T5: categorical position for Month/Quarter/Day, the value itself otherwise."""
    if x in CATEGORY_ORDERS:
        return F.array_position(F.array(*[F.lit(v) for v in CATEGORY_ORDERS[x]]), F.col(x))
    return F.col(x)


def chart_rollup(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Sum of any y by any x (null x dropped, y coerced strictly and zero-filled)."""
    keys = list(keys)
    ytype = df.schema[y].dataType
    yv = F.col(y).cast("double") if isinstance(ytype, T.NumericType) else strict_number(F.col(y))
    out = (df.where(F.col(x).isNotNull())
           .groupBy(*keys, x).agg(F.sum(F.coalesce(yv, F.lit(0.0))).alias(y)))
    if x in CATEGORY_ORDERS:
        out = out.withColumn("sort_pos", order_key(out, x))
    return out


def trend_daily(clean: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Revenue per day, no gap-fill."""
    return clean.groupBy(*keys, "Date").agg(F.sum("Revenue").alias("Revenue"))


def monthly(clean: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Revenue by (MonthNum, Month); years are merged as in the reference."""
    return clean.groupBy(*keys, "MonthNum", "Month").agg(F.sum("Revenue").alias("Revenue"))


def weekday(clean: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A15 + J2: seven rows per segment in weekday order, absent days 0.

    One pass over the rows: sums per (segment, day), folded into a ≤ 7-entry map per
    segment, then the fixed weekday list is exploded against the map.
    """
    user_keys = list(keys)
    df, k = seg_keys(clean, user_keys)
    agg = df.groupBy(*k, "Day").agg(F.sum("Revenue").alias("Revenue"))
    per_seg = agg.groupBy(*k).agg(F.map_from_entries(F.collect_list(F.struct("Day", "Revenue"))).alias("__m"))
    days = F.array(*[F.lit(d) for d in WEEKDAYS])
    out = (per_seg.select(*k, "__m", F.posexplode(days).alias("day_pos", "Day"))
           .select(*k, "day_pos", "Day", F.coalesce(F.element_at("__m", F.col("Day")), F.lit(0.0)).alias("Revenue")))
    return drop_seg(out)


def top_products(clean: DataFrame, keys: Sequence[str] = (), k: int = TOP_PRODUCTS) -> DataFrame:
    """The k best products by revenue (ties by name) per segment.

    Whole table: a distributed top-k (TakeOrderedAndProject), so no single task sees all
    products; per segment: row_number inside each segment.
    """
    keys = list(keys)
    agg = clean.groupBy(*keys, "Product").agg(F.sum("Revenue").alias("Revenue"))
    return group_top_k(agg, keys, [F.col("Revenue").desc(), F.col("Product")], k)


def region_revenue(clean: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Revenue by region (the pie panel), sorted by revenue descending."""
    keys = list(keys)
    out = clean.groupBy(*keys, "Region").agg(F.sum("Revenue").alias("Revenue"))
    return out.orderBy(*keys, F.col("Revenue").desc(), "Region")


def product_region(clean: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A16 + A23: Revenue, Profit, Quantity per (Product, Region) plus the marker size.

    Profit is the `Profit` column when present, else revenue × 0.35 (documented fallback).
    The segment maximum is a second aggregate over the same exchange (it takes the maximum of
    whole rows, so both sides read the same columns and the input is scanned once); for the
    whole table it is one row and joins as a broadcast. Sorted by revenue within a segment.
    """
    keys = list(keys)
    profit = (F.coalesce(F.col("Profit").try_cast("double"), F.lit(0.0)) if "Profit" in clean.columns
              else F.col("Revenue") * PROFIT_RATIO)
    perf = (clean.groupBy(*keys, "Product", "Region")
            .agg(F.sum("Revenue").alias("Revenue"), F.sum(profit).alias("Profit"),
                 F.sum("Quantity").alias("Quantity")))
    largest = F.max(F.struct("Revenue", "Profit", "Quantity")).getField("Revenue").alias("__max")
    mx = perf.groupBy(*keys).agg(largest)
    denom = F.when(F.col("__max") > 0, F.col("__max")).otherwise(F.lit(1.0))
    size = F.least(F.lit(MARKER_MAX), F.greatest(F.lit(MARKER_MIN), F.col("Revenue") / denom * MARKER_MAX))
    both = perf.join(mx, keys) if keys else perf.join(F.broadcast(mx))
    return both.withColumn("PointSize", size).drop("__max").orderBy(*keys, F.col("Revenue").desc(), "Product", "Region")


def heatmap(clean: DataFrame, keys: Sequence[str] = (), months: Sequence[str] | None = None) -> DataFrame:
    """Weekday × month revenue; absent cells 0, absent weekdays a null row (Q26).

    One lazy plan over the explicit list of months (all twelve unless given); the reference
    drops months without data, which `drop_absent_months` does at the sink.
    """
    user_keys, months = list(keys), list(months or MONTHS)
    df, k = seg_keys(clean, user_keys)
    piv = df.groupBy(*k, "Day").pivot("Month", months).agg(F.sum("Revenue")).na.fill(0.0, subset=months)
    # the seven weekdays of a segment against its at most seven pivot rows, folded into a map
    cells = F.struct(*[F.col(f"`{m}`") for m in months])
    per_seg = piv.groupBy(*k).agg(F.map_from_entries(F.collect_list(F.struct("Day", cells.alias("cells")))).alias("__m"))
    days = F.array(*[F.lit(d) for d in WEEKDAYS])
    out = (per_seg.select(*k, "__m", F.posexplode(days).alias("day_pos", "Day"))
           .withColumn("__c", F.try_element_at("__m", F.col("Day"))))
    return drop_seg(out.select(*k, "day_pos", "Day", *[F.col("__c").getField(m).alias(m) for m in months]))


def drop_absent_months(table: DataFrame) -> DataFrame:
    """The heatmap without the months that hold no revenue anywhere (an action: one row is read)."""
    months = [c for c in table.columns if c in MONTHS]
    seen = table.agg(*[F.max(F.col(m) != 0).alias(m) for m in months]).first()
    return table.drop(*[m for m in months if not seen[m]])


def data_quality(clean: DataFrame, keys: Sequence[str] = (), schema_fields: int = 5) -> DataFrame:
    """A19 + A20: missing cells (null or NaN) over all columns, rows, date span, field count."""
    user_keys = list(keys)
    df, k = seg_keys(clean, user_keys)
    value_cols = [f for f in clean.schema.fields]
    miss = []
    for f in value_cols:
        c = F.col(f"`{f.name}`")
        cond = c.isNull()
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cond = cond | F.isnan(c)
        miss.append(F.when(cond, 1).otherwise(0))
    missing = sum(miss[1:], miss[0]) if miss else F.lit(0)
    ncols = len(value_cols)
    out = (df.groupBy(*k).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(missing).cast("bigint").alias("missing_cells"),
        F.min("Date").alias("date_start"), F.max("Date").alias("date_end"))
        .withColumn("total_cells", F.col("rows") * F.lit(ncols))
        .withColumn("missing_rate", F.when(F.col("total_cells") > 0,
                                           F.col("missing_cells") / F.col("total_cells") * 100)
                    .otherwise(F.lit(0.0)))
        .withColumn("date_span_days", F.coalesce(F.datediff("date_end", "date_start") + 1, F.lit(0)))
        .withColumn("schema_fields", F.lit(schema_fields)))
    return drop_seg(out)
