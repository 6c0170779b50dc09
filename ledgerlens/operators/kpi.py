"""KPI record per segment.

The cleaned rows become mergeable states per (Product, Region, Date) and the segment keys
(`kpi_state`), written once. The record of a segment merges from them level by level (total, product,
region, day), and a last aggregate puts the four levels of a segment into one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import drop_seg, seg_keys
from . import kpi_state as ST

KPI_FIELDS = [
    "total_revenue", "avg_revenue", "total_records", "profit", "margin_pct", "unique_products",
    "unique_regions", "growth_pct", "volatility_pct", "top_product", "top_product_revenue",
    "top_product_share", "weak_product", "weak_product_revenue", "weak_product_share",
    "top_region", "top_region_revenue", "top_region_share", "weak_region", "weak_region_revenue",
    "weak_region_share",
]

# Profit ratio when no Profit column exists, growth windows, risk thresholds.
PROFIT_RATIO = 0.35
GROWTH_LONG_DAYS = 60
GROWTH_WINDOW = 30
GROWTH_MIN_DAYS = 10
RISK_HIGH_VOLATILITY = 40
RISK_MEDIUM_VOLATILITY = 35


def _growth(day_map: F.Column, first_ds: F.Column, last_ds: F.Column) -> F.Column:
    """A6 from a segment's day -> revenue map; gap days are zero, so period means are period
    sums over period lengths and no calendar rows are materialised."""
    n = F.datediff(last_ds, first_ds) + 1
    half = F.floor(n / 2)
    entries = F.map_entries(day_map)

    def total(cond):
        return F.aggregate(F.filter(entries, lambda d: cond(F.datediff(d["key"], first_ds))),
                           F.lit(0.0), lambda a, d: a + d["value"])

    s_last = total(lambda p: p >= n - GROWTH_WINDOW)
    s_prev = total(lambda p: (p >= n - GROWTH_LONG_DAYS) & (p < n - GROWTH_WINDOW))
    s_second = total(lambda p: p >= half)
    s_first = total(lambda p: p < half)
    s_all = total(lambda p: p >= 0)
    recent = (F.when(n >= GROWTH_LONG_DAYS, s_last / GROWTH_WINDOW)
              .when(n >= GROWTH_MIN_DAYS, s_second / (n - half)).otherwise(s_all / n))
    previous = (F.when(n >= GROWTH_LONG_DAYS, s_prev / GROWTH_WINDOW)
                .when(n >= GROWTH_MIN_DAYS, s_first / half).otherwise(s_all / n))
    return (F.when(previous > 0, (recent - previous) / previous * 100)
            .when(recent > 0, F.lit(100.0)).otherwise(F.lit(0.0)))


def kpis_from_rollup(g: DataFrame, keys: list[str], with_days: bool = False) -> DataFrame:
    """The KPI record from the rows of the four levels in one aggregation per segment.

    Totals are the single `total` row; top/weak by `min_by` over the product/region rows
    (ties by name); the day rows become one (ds, y) array per segment (bounded by its
    calendar) for the growth windows. No joins, one shuffle over already-aggregated rows.
    """
    lvl = F.col("level")

    def at(level: str, c: F.Column) -> F.Column:
        return F.when(lvl == level, c)

    def ranked(level: str, name: str, sign: int):
        item = F.struct(F.col(name).alias("name"), F.col("rev").alias("rev"))
        order = F.struct((F.col("rev") * sign).alias("r"), F.col(name).alias("n"))
        return F.min_by(at(level, item), at(level, order))

    agg = g.groupBy(*keys).agg(
        F.max(at("total", F.col("rev"))).alias("total_revenue"),
        F.max(at("total", F.col("avg_rev"))).alias("avg_revenue"),
        F.max(at("total", F.col("n"))).alias("total_records"),
        F.max(at("total", F.col("std_rev"))).alias("std_rev"),
        F.max(at("total", F.col("profit_sum"))).alias("profit_sum"),
        F.max(at("total", F.col("first_ds"))).alias("first_ds"),
        F.max(at("total", F.col("last_ds"))).alias("last_ds"),
        F.max(at("total", F.col("has_profit"))).alias("has_profit"),
        F.count(at("product", F.lit(1))).alias("unique_products"),
        F.count(at("region", F.lit(1))).alias("unique_regions"),
        ranked("product", "Product_", -1).alias("tp"), ranked("product", "Product_", 1).alias("wp"),
        ranked("region", "Region_", -1).alias("tr"), ranked("region", "Region_", 1).alias("wr"),
        # an aggregate output, so later lambdas read it as an attribute (no per-element rebuild)
        F.map_from_entries(F.collect_list(at("day", F.struct(F.col("Date_").alias("ds"), F.col("rev").alias("y")))))
        .alias("day_map"))

    total = F.col("total_revenue")
    profit = F.when(F.col("has_profit"), F.coalesce(F.col("profit_sum"), F.lit(0.0))) \
        .otherwise(total * PROFIT_RATIO)
    share = lambda c: F.when(total > 0, c / total * 100).otherwise(F.lit(0.0))
    out = agg.withColumn("profit", profit)
    return out.select(
        *keys,
        "total_revenue", "avg_revenue", "total_records", "profit",
        F.when(total > 0, F.col("profit") / total * 100).otherwise(F.lit(0.0)).alias("margin_pct"),
        "unique_products", "unique_regions",
        F.coalesce(_growth(F.col("day_map"), F.col("first_ds"), F.col("last_ds")), F.lit(0.0)).alias("growth_pct"),
        F.when(F.col("avg_revenue") > 0, F.col("std_rev") / F.col("avg_revenue") * 100)
        .otherwise(F.lit(0.0)).alias("volatility_pct"),
        F.col("tp.name").alias("top_product"), F.col("tp.rev").alias("top_product_revenue"),
        share(F.col("tp.rev")).alias("top_product_share"),
        F.col("wp.name").alias("weak_product"), F.col("wp.rev").alias("weak_product_revenue"),
        share(F.col("wp.rev")).alias("weak_product_share"),
        F.col("tr.name").alias("top_region"), F.col("tr.rev").alias("top_region_revenue"),
        share(F.col("tr.rev")).alias("top_region_share"),
        F.col("wr.name").alias("weak_region"), F.col("wr.rev").alias("weak_region_revenue"),
        share(F.col("wr.rev")).alias("weak_region_share"),
        (F.datediff("last_ds", "first_ds") + 1).alias("n_days"),
        *(["day_map", "first_ds", "last_ds"] if with_days else []),
    )


def written_states(clean: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The states of `clean` by its segment keys, written once: every level merges from the same files."""
    return ST.write_states(ST.daily_states(clean, keys))


def calculate_kpis(clean: DataFrame, keys: Sequence[str] = (), with_days: bool = False) -> DataFrame:
    """The 21-field KPI record, one row per segment (`keys=[]` = whole table).

    An empty whole-table input gives the all-zero record, as the reference does. `with_days` keeps
    each segment's day -> revenue map and date bounds so day-level rules can run as column
    expressions on the same row.
    """
    return kpis_from_states(written_states(clean, keys), keys, with_days)


def kpis_from_states(states: DataFrame, keys: Sequence[str] = (), with_days: bool = False) -> DataFrame:
    """The KPI record from states alone, of whatever days, segments and batches they are."""
    user_keys = list(keys)
    states, k = seg_keys(states, user_keys)
    out = drop_seg(kpis_from_rollup(ST.level_rollup(states, k), k, with_days))
    if not user_keys:
        # whole table: the real record (≥ 1 row counted) outranks the all-zero one, which
        # only survives for an empty input; a 2-row top-1, no emptiness probe
        out = (out.unionByName(zero_kpis(states.sparkSession), allowMissingColumns=True)
               .orderBy(F.col("total_records").desc()).limit(1))
    return out


def zero_kpis(spark) -> DataFrame:
    return spark.createDataFrame(
        [(0.0, 0.0, 0, 0.0, 0.0, 0, 0, 0.0, 0.0, None, 0.0, 0.0, None, 0.0, 0.0,
          None, 0.0, 0.0, None, 0.0, 0.0, 0)],
        "total_revenue double, avg_revenue double, total_records bigint, profit double, "
        "margin_pct double, unique_products bigint, unique_regions bigint, growth_pct double, "
        "volatility_pct double, top_product string, top_product_revenue double, "
        "top_product_share double, weak_product string, weak_product_revenue double, "
        "weak_product_share double, top_region string, top_region_revenue double, "
        "top_region_share double, weak_region string, weak_region_revenue double, "
        "weak_region_share double, n_days int")


def normalize_kpis(kpis: DataFrame) -> DataFrame:
    """P18 + F9: dashboard names with fallbacks (first present column wins, else a default)."""
    have = set(kpis.columns)

    def pick(*names, default):
        cols = [F.col(n) for n in names if n in have]
        return F.coalesce(*cols, F.lit(default)) if cols else F.lit(default)

    keep = [c for c in kpis.columns if c not in KPI_FIELDS]
    return kpis.select(
        *keep,
        pick("total_revenue", default=0.0).alias("total_revenue"),
        pick("avg_revenue", default=0.0).alias("avg_revenue"),
        pick("total_records", default=0).alias("total_records"),
        pick("profit", default=0.0).alias("profit"),
        pick("margin", "margin_pct", default=0.0).alias("margin"),
        pick("unique_items", "unique_products", default=0).alias("unique_items"),
        pick("growth", "growth_pct", default=0.0).alias("growth"),
        pick("volatility", "volatility_pct", default=0.0).alias("volatility"),
        pick("top_product", default=None).cast("string").alias("top_product"),
        pick("top_product_value", "top_product_revenue", default=0.0).alias("top_product_value"),
        pick("weak_product", default=None).cast("string").alias("weak_product"),
        pick("weak_product_value", "weak_product_revenue", default=0.0).alias("weak_product_value"),
        pick("top_region", default=None).cast("string").alias("top_region"),
        pick("top_region_value", "top_region_revenue", default=0.0).alias("top_region_value"),
        pick("weak_region", default=None).cast("string").alias("weak_region"),
        pick("weak_region_value", "weak_region_revenue", default=0.0).alias("weak_region_value"),
        pick("unique_regions", default=0).alias("unique_regions"))


def risk_columns(kpis: DataFrame) -> DataFrame:
    """R4 (High/Medium/Low), R5 (copilot elevated/controlled) and A24 (stability)."""
    # a missing volatility (one row) compares as not above any threshold
    g, v = F.col("growth_pct"), F.col("volatility_pct")
    label = (F.when((g < 0) & (v > RISK_HIGH_VOLATILITY), "High")
             .when((g < 0) | (v > RISK_MEDIUM_VOLATILITY), "Medium").otherwise("Low"))
    copilot = F.when((v > RISK_HIGH_VOLATILITY) | (g < 0), "elevated").otherwise("controlled")
    stability = F.greatest(F.lit(0.0), 100 - F.least(F.lit(100.0), F.col("volatility_pct")))
    return kpis.withColumns({"risk_label": label, "copilot_risk": copilot, "stability_pct": stability})
