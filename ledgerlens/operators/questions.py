"""Copilot: question intents, chat context and rule-based answers.

Questions are rows (e.g. the user turns of a conversation table); the context is one
row per segment, joined to the questions on the segment keys, and every answer is a
`when` chain of text templates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import currency, fixed, fixed_or_nan
from ..plans.topk import group_top_k
from . import insights as I
from .insights import template

# Intent rules in the reference's order (first match wins), then "general".
INTENT_RULES = [
    ("top_product", ["top product", "best product", "product best", "highest product"]),
    ("weak_product", ["weak product", "bad product", "underperforming product"]),
    ("top_region", ["top region", "best region", "which region", "region best"]),
    ("weak_region", ["weak region", "low region", "region weak"]),
    ("growth", ["growth", "trend", "revenue up", "revenue down"]),
    ("margin", ["margin", "profit", "profit margin"]),
    ("forecast", ["forecast", "prediction", "next month", "future sales"]),
    ("risk", ["risk", "volatile", "stability", "stable"]),
    ("summary", ["summary", "overview", "business summary"]),
    ("actions", ["action", "recommend", "next step", "what should i do"]),
]

# Answer texts per intent.
ANSWERS = {
    "top_product": "Top performing product is **{tp}**. Total revenue contribution is strong, so this product "
                   "should be prioritized in inventory and marketing.",
    "weak_product": "Underperforming product is **{wp}**. It needs review on pricing, positioning, or demand-side issues.",
    "top_region": "Best region is **{tr}**. This region is currently contributing the most to revenue, so it is a "
                  "good candidate for more campaigns.",
    "weak_region": "Weak region is **{wr}**. That area should be checked for lower demand, weak distribution, or "
                   "campaign gaps.",
    "growth_up": "Revenue is trending upward with **{growth}** growth versus the previous period. "
                 "Current total revenue is {total}.",
    "growth_down": "Revenue is under pressure with **{growth}** change versus the previous period. "
                   "You should review campaigns, pricing, and weak segments.",
    "margin": "Profit margin is **{margin}**. If you want better margin, focus on stronger products and optimize "
              "weak segments.",
    "forecast": "Forecasting model selected is **{model}**. Expected revenue over the selected horizon is "
                "**{fsum}**. Use this for stock and campaign planning.",
    "forecast_missing": "Forecast is not available yet. Please generate forecast first.",
    "risk_elevated": "Business risk looks **elevated**. Volatility is {vol} and growth is {growth}. "
                     "Sales are not fully stable right now.",
    "risk_controlled": "Business risk looks **controlled**. Volatility is {vol} and growth is {growth}. "
                       "Current performance seems reasonably stable.",
    "summary": "{headline} {text}",
    "actions": "Recommended actions:\n- {recs}",
    "actions_none": "No clear action found. Current performance seems stable.",
    "general": "Here is the current business snapshot:\n- Total revenue: {total}\n- Margin: {margin}\n"
               "- Growth: {growth}\n- Volatility: {vol}\n- Top product: {tp}\n- Top region: {tr}\n\n"
               "You can ask me things like:\n- Which product is performing best?\n"
               "- Which region needs attention?\n- What should I do next?\n- Give me a short summary.",
}
ANSWERED_ACTIONS = 3
HISTORY_TURNS = 10


def intent(question: F.Column) -> F.Column:
    """Ordered substring rules over the lower-cased, trimmed question."""
    q = F.lower(F.trim(question))
    expr = None
    for name, phrases in INTENT_RULES:
        cond = None
        for p in phrases:
            c = q.contains(p)
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit("general"))


def chat_context(clean: DataFrame, keys: Sequence[str] = (), forecast: DataFrame | None = None) -> DataFrame:
    """One flat record per segment: KPIs, summary and forecast fields."""
    keys = list(keys)
    frame = I.analysis_frame(clean, keys, forecast)
    cols = ["total_records", "total_revenue", "margin_pct", "growth_pct", "volatility_pct",
            "top_product", "top_region", "weak_product", "weak_region", "best_model", "forecast_sum"]
    return I.summary_columns(frame, keys, keep=True).select(
        *keys, *cols, "headline", "summary_text", "bullets", "recommendations")


def answer(ctx_cols_prefix: str = "") -> F.Column:
    """The answer text for the row's `intent` given the joined context columns."""
    c = lambda n: F.col(ctx_cols_prefix + n)
    none_text = lambda col: F.coalesce(col, F.lit("None"))
    total = currency(c("total_revenue"), spaced=True)
    margin = F.concat(fixed(c("margin_pct"), 1), F.lit("%"))
    growth = F.concat(fixed(c("growth_pct"), 1), F.lit("%"))
    vol = F.concat(fixed_or_nan(c("volatility_pct"), 0), F.lit("%"))
    fsum = currency(c("forecast_sum"), spaced=True)
    tp, tr = none_text(c("top_product")), none_text(c("top_region"))
    wp, wr = none_text(c("weak_product")), none_text(c("weak_region"))
    recs = F.slice(c("recommendations"), 1, ANSWERED_ACTIONS)
    it = F.col("intent")
    return (
        F.when(it == "top_product", template(ANSWERS["top_product"], tp=tp))
        .when(it == "weak_product", template(ANSWERS["weak_product"], wp=wp))
        .when(it == "top_region", template(ANSWERS["top_region"], tr=tr))
        .when(it == "weak_region", template(ANSWERS["weak_region"], wr=wr))
        .when(it == "growth", F.when(c("growth_pct") >= 0, template(ANSWERS["growth_up"], growth=growth, total=total))
              .otherwise(template(ANSWERS["growth_down"], growth=growth)))
        .when(it == "margin", template(ANSWERS["margin"], margin=margin))
        .when(it == "forecast", F.when(I.truthy(c("best_model")) & c("forecast_sum").isNotNull(),
                                       template(ANSWERS["forecast"], model=c("best_model"), fsum=fsum))
              .otherwise(F.lit(ANSWERS["forecast_missing"])))
        .when(it == "risk", F.when((c("volatility_pct") > I.VOLATILITY_ALERT) | (c("growth_pct") < 0),
                                   template(ANSWERS["risk_elevated"], vol=vol, growth=growth))
              .otherwise(template(ANSWERS["risk_controlled"], vol=vol, growth=growth)))
        .when(it == "summary", template(ANSWERS["summary"], headline=c("headline"), text=c("summary_text")))
        .when(it == "actions", F.when(F.size(recs) > 0,
                                      template(ANSWERS["actions"], recs=F.array_join(recs, "\n- ")))
              .otherwise(F.lit(ANSWERS["actions_none"])))
        .otherwise(template(ANSWERS["general"], total=total, margin=margin, growth=growth, vol=vol, tp=tp, tr=tr))
    )


def answer_questions(questions: DataFrame, context: DataFrame, text_col: str = "text",
                     keys: Sequence[str] = ()) -> DataFrame:
    """Classify each question and answer it from its segment's context row."""
    keys = list(keys)
    q = questions.withColumn("intent", intent(F.col(text_col)))
    if keys:
        joined = q.join(context, keys, "left")
    else:
        # whole-table context: a global aggregate, exactly one row -> a proven broadcast
        joined = q.withColumn("__j", F.lit(0)).join(F.broadcast(context.withColumn("__j", F.lit(0))),
                                                     "__j", "left").drop("__j")
    return joined.withColumn("answer", answer())


def last_turns(conversations: DataFrame, n: int = HISTORY_TURNS, key: str = "conv_id",
               order: str = "turn") -> DataFrame:
    """The last n messages of every conversation (salted top-k, so one huge
    conversation is ranked in many tasks, not one)."""
    return group_top_k(conversations, [key], [F.col(order).desc()], n, "__rk").drop("__rk")
