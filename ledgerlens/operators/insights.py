"""Rule-based insights and the executive summary.

Both are projections of the one-row-per-segment analysis frame (KPIs + anomaly count
+ optional forecast totals): the rule list is an `array` of conditional structs, compacted
and exploded with its position, so text generation never leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import currency, fixed, fixed_or_nan
from . import anomaly as AN
from . import kpi as K

# Insight texts (type, title, detail and action), in rule order.
TREND_UP = ("success", "Revenue trend is positive", "Revenue growth is {g}% versus the previous period.",
            "Keep the current strategy and scale the best-performing channels.")
TREND_DOWN = ("warning", "Revenue trend needs attention", "Revenue dropped by {g}% versus the previous period.",
              "Review pricing, promotions, and weak regions or products.")
TOP_PRODUCT = ("success", "Top product: {name}", "Total revenue: {rev} ({share}% of total).",
               "Increase inventory and marketing for {name}.")
WEAK_PRODUCT = ("warning", "Underperforming product: {name}", "Total revenue: {rev} ({share}% of total).",
                "Review pricing or reposition {name}.")
TOP_REGION = ("success", "Best region: {name}", "Revenue contribution: {rev} ({share}% of total).",
              "Push more campaigns in {name}.")
WEAK_REGION = ("warning", "Region needing attention: {name}", "Revenue contribution: {rev} ({share}% of total).",
               "Investigate demand and channel issues in {name}.")
VOLATILE = ("warning", "Sales are volatile", "Revenue volatility is {v}%.",
            "Focus on repeat customers and consistent campaigns.")
STABLE = ("success", "Sales are stable", "Revenue volatility is {v}%.",
          "Keep the current strategy and monitor seasonal patterns.")
ANOMALIES = ("info", "Anomalies detected", "{n} unusual revenue days were found.",
             "Check spikes or drops for campaign, stock, or pricing issues.")
NO_DATA = ("info", "No usable data found", "Please upload a valid sales file to generate insights.",
           "Use a CSV or Excel file with sales records.")
VOLATILITY_ALERT = 40

# Executive summary texts.
HEADLINE_UP = "Revenue is trending upward."
HEADLINE_DOWN = "Revenue is under pressure."
BULLET_TOTAL = "Total revenue: {x}."
BULLET_AVERAGE = "Average order value: {x}."
BULLET_GROWTH = "Growth versus previous period: {x}%."
BULLET_TOP_PRODUCT = "Top product: {name} with {x} revenue."
BULLET_TOP_REGION = "Top region: {name} with {x} revenue."
BULLET_FORECAST = "Best forecast model: {model}. Expected sales over the selected horizon: {x}."
REC_GROWTH = "Launch a sales push for weak products and regions."
REC_VOLATILITY = "Stabilize revenue with repeat-customer and retention campaigns."
REC_TOP_PRODUCT = "Promote {name} and keep inventory ready."
REC_TOP_REGION = "Invest more in {name} since it is the strongest region."
REC_ANOMALIES = "Investigate unusual spikes and drops before they become bigger issues."
REC_FORECAST = "Use the forecast to plan inventory and campaign timing."
REC_DEFAULT = "Keep monitoring data and continue the current strategy."
EMPTY_SUMMARY = ("No usable data was found.", "Upload a sales file to generate a business summary.",
                 "No records available.", "Upload a valid CSV or Excel file.")
MAX_RECOMMENDATIONS = 5


def template(fixed_text: str, **parts) -> F.Column:
    """Fill `{name}` slots of a fixed text with columns (concat of literal pieces and columns)."""
    out, rest = [], fixed_text
    while "{" in rest:
        pre, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        if pre:
            out.append(F.lit(pre))
        out.append(parts[name])
    if rest:
        out.append(F.lit(rest))
    return F.concat(*out) if len(out) > 1 else out[0]


def _row(spec, **parts) -> F.Column:
    kind, title, detail, action = spec
    return F.struct(F.lit(kind).alias("type"), template(title, **parts).alias("title"),
                    template(detail, **parts).alias("detail"), template(action, **parts).alias("action"))


def truthy(c: F.Column) -> F.Column:
    """Python truthiness of a name: not null and not empty."""
    return c.isNotNull() & (c != F.lit(""))


def analysis_frame(clean: DataFrame, keys: Sequence[str] = (), forecast: DataFrame | None = None) -> DataFrame:
    """KPIs + reported anomaly count (+ forecast model and sum) per segment.

    One aggregation over the shared grouping-sets rows yields the KPIs and each segment's
    day array; the anomaly count is a column expression on that array, so no frame is
    joined back to itself. `forecast`, when given, is `(keys…, best_model, forecast_sum)`.
    """
    user_keys = list(keys)
    kp = K.calculate_kpis(clean, user_keys, with_days=True)
    out = (kp.withColumn("anomaly_count",
                         F.coalesce(AN.reported_count(F.col("day_map"), F.col("first_ds"), F.col("last_ds")),
                                    F.lit(0)).cast("bigint"))
           .drop("day_map", "first_ds", "last_ds"))
    if forecast is not None:
        fc = forecast.select(*user_keys, "best_model", "forecast_sum")
        if user_keys:
            out = out.join(fc, user_keys, "left")
        else:
            out = out.withColumn("__j", F.lit(0)).join(fc.withColumn("__j", F.lit(0)), "__j", "left").drop("__j")
    else:
        out = out.withColumn("best_model", F.lit(None).cast("string")) \
                 .withColumn("forecast_sum", F.lit(None).cast("double"))
    return out


def insight_rules(frame_cols=F.col) -> F.Column:
    """R2 as one array column of (type, title, detail, action) structs in rule order."""
    c = frame_cols
    g, v = c("growth_pct"), c("volatility_pct")
    one = lambda x: fixed(x, 1)
    rules = F.array(
        F.when(g >= 0, _row(TREND_UP, g=one(g))).otherwise(_row(TREND_DOWN, g=one(F.abs(g)))),
        F.when(truthy(c("top_product")), _row(TOP_PRODUCT, name=c("top_product"),
               rev=currency(c("top_product_revenue")), share=one(c("top_product_share")))),
        F.when(truthy(c("weak_product")), _row(WEAK_PRODUCT, name=c("weak_product"),
               rev=currency(c("weak_product_revenue")), share=one(c("weak_product_share")))),
        F.when(truthy(c("top_region")), _row(TOP_REGION, name=c("top_region"),
               rev=currency(c("top_region_revenue")), share=one(c("top_region_share")))),
        F.when(truthy(c("weak_region")), _row(WEAK_REGION, name=c("weak_region"),
               rev=currency(c("weak_region_revenue")), share=one(c("weak_region_share")))),
        F.when(v > VOLATILITY_ALERT, _row(VOLATILE, v=fixed_or_nan(v, 0)))
        .otherwise(_row(STABLE, v=fixed_or_nan(v, 0))),
        F.when(c("anomaly_count") > 0, _row(ANOMALIES, n=c("anomaly_count").cast("string"))),
    )
    return F.when(c("total_records") == 0, F.array(_row(NO_DATA))).otherwise(F.array_compact(rules))


def insight_rows(frame: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """R2 on an analysis frame: one row per emitted insight with its rule position."""
    keys = list(keys)
    return (frame.select(*keys, F.posexplode(insight_rules()).alias("pos", "insight"))
            .select(*keys, "pos", "insight.type", "insight.title", "insight.detail", "insight.action"))


def generate_insights(clean: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return insight_rows(analysis_frame(clean, keys), keys)


def summary_columns(frame: DataFrame, keys: Sequence[str] = (), keep: bool = False) -> DataFrame:
    """Headline, bullets, summary text and up to five recommendations per segment.

    The forecast bullet is printed only when a forecast exists for the segment (Q28).
    `keep` returns the frame's own columns too (so callers need no join back).
    """
    keys = list(frame.columns) if keep else list(keys)
    g, v = F.col("growth_pct"), F.col("volatility_pct")
    tp, tr = F.col("top_product"), F.col("top_region")
    has_fc = F.col("best_model").isNotNull()
    bullets = F.array_compact(F.array(
        template(BULLET_TOTAL, x=currency(F.col("total_revenue"))),
        template(BULLET_AVERAGE, x=currency(F.col("avg_revenue"))),
        template(BULLET_GROWTH, x=fixed(g, 1)),
        F.when(truthy(tp), template(BULLET_TOP_PRODUCT, name=tp, x=currency(F.col("top_product_revenue")))),
        F.when(truthy(tr), template(BULLET_TOP_REGION, name=tr, x=currency(F.col("top_region_revenue")))),
        F.when(has_fc, template(BULLET_FORECAST, model=F.col("best_model"),
                                x=currency(F.coalesce(F.col("forecast_sum"), F.lit(0.0))))),
    ))
    recs = F.array_compact(F.array(
        F.when(g < 0, F.lit(REC_GROWTH)),
        F.when(v > VOLATILITY_ALERT, F.lit(REC_VOLATILITY)),
        F.when(truthy(tp), template(REC_TOP_PRODUCT, name=tp)),
        F.when(truthy(tr), template(REC_TOP_REGION, name=tr)),
        F.when(F.col("anomaly_count") > 0, F.lit(REC_ANOMALIES)),
        F.when(has_fc & (F.col("forecast_sum") > 0), F.lit(REC_FORECAST)),
    ))
    recs = F.when(F.size(recs) == 0, F.array(F.lit(REC_DEFAULT))).otherwise(F.slice(recs, 1, MAX_RECOMMENDATIONS))
    empty = F.col("total_records") == 0
    headline = F.when(empty, F.lit(EMPTY_SUMMARY[0])).when(g >= 0, F.lit(HEADLINE_UP)).otherwise(F.lit(HEADLINE_DOWN))
    bullets = F.when(empty, F.array(F.lit(EMPTY_SUMMARY[2]))).otherwise(bullets)
    recs = F.when(empty, F.array(F.lit(EMPTY_SUMMARY[3]))).otherwise(recs)
    text = F.when(empty, F.lit(EMPTY_SUMMARY[1])).otherwise(F.array_join(bullets, " "))
    return frame.select(*keys, headline.alias("headline"), text.alias("summary_text"),
                        bullets.alias("bullets"), recs.alias("recommendations"))


def executive_summary(clean: DataFrame, keys: Sequence[str] = (), forecast: DataFrame | None = None) -> DataFrame:
    return summary_columns(analysis_frame(clean, keys, forecast), keys)


def risk(clean: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """R4 + R5 + A24 per segment."""
    keys = list(keys)
    return K.risk_columns(K.calculate_kpis(clean, keys)).select(
        *keys, "growth_pct", "volatility_pct", "risk_label", "copilot_risk", "stability_pct")
