"""Oracle SQL for the rule texts: insights, summary, risk, intents and answers.

The texts come from the same fixed values the Spark operators use; only the
rendering (`||`, `format`) is SQL.
"""

from __future__ import annotations

from ..operators import insights as I
from ..operators import questions as Q
from .kpi_sql import kpi_ctes


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def tpl(fixed_text: str, **parts: str) -> str:
    out, rest = [], fixed_text
    while "{" in rest:
        pre, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        if pre:
            out.append(lit(pre))
        out.append(f"({parts[name]})")
    if rest:
        out.append(lit(rest))
    return " || ".join(out)


def cur(x: str, spaced: bool = False) -> str:
    return f"""{lit("$ " if spaced else "$")} || format('{{:,.0f}}', {x})"""


def f1(x: str) -> str:
    return f"format('{{:.1f}}', {x})"


def f0nan(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'nan' ELSE format('{{:.0f}}', {x}) END"


def truthy(x: str) -> str:
    return f"({x} IS NOT NULL AND {x} <> '')"


def anomaly_count_ctes(src: str, keys: list[str]) -> str:
    """CTEs ending in `acnt(keys, anomaly_count)` = number of reported anomalies (≤ 5)."""
    kq = [f'"{c}"' for c in keys] or ['"seg"']
    kl = ", ".join(kq)
    seg = "" if keys else ', 1 AS "seg"'
    on = " AND ".join(f"f.{c} = b.{c}" for c in kq)
    return f"""a_src AS (SELECT *{seg} FROM {src}),
a_daily AS (SELECT {kl}, "Date" AS ds, sum("Revenue") AS y FROM a_src GROUP BY {kl}, "Date"),
a_bounds AS (SELECT {kl}, min(ds) AS lo, max(ds) AS hi FROM a_daily GROUP BY {kl}),
a_cal AS (SELECT {kl}, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ds FROM a_bounds),
a_filled AS (SELECT {", ".join("c." + c for c in kq)}, c.ds, COALESCE(d.y, 0.0) AS y
             FROM a_cal c LEFT JOIN a_daily d ON c.ds = d.ds{"".join(f" AND c.{c} = d.{c}" for c in kq)}),
a_b AS (SELECT {kl}, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3, count(*) AS n
        FROM a_filled GROUP BY {kl}),
a_fl AS (SELECT {", ".join("f." + c for c in kq)}, f.ds FROM a_filled f JOIN a_b b ON {on}
         WHERE b.n >= 10 AND (f.y < b.q1 - 1.5 * (b.q3 - b.q1) OR f.y > b.q3 + 1.5 * (b.q3 - b.q1))),
acnt AS (SELECT {kl}, least(count(*), 5) AS anomaly_count FROM a_fl GROUP BY {kl})"""


def analysis_ctes(src_ctes: str, src: str, keys: list[str]) -> tuple[str, list[str]]:
    """`WITH …` text ending in CTE `f`: KPI row + anomaly_count per segment."""
    kctes, k = kpi_ctes(src, keys)
    using = ", ".join(k)
    text = (f"WITH {src_ctes},\n{kctes},\n{anomaly_count_ctes(src, keys)},\n"
            f"f AS (SELECT kpi.*, COALESCE(acnt.anomaly_count, 0) AS anomaly_count "
            f"FROM kpi LEFT JOIN acnt USING ({using}))\n")
    return text, k


def insights_sql(src_ctes: str, src: str, keys: list[str]) -> str:
    head, k = analysis_ctes(src_ctes, src, keys)
    kl = ", ".join(k)
    out_keys = "".join(f'"{c}", ' for c in keys)

    def rule(rule_no: int, spec, cond: str | None, **parts) -> str:
        kind, title, detail, action = spec
        where = f" WHERE {cond}" if cond else ""
        return (f"SELECT {kl}, {rule_no} AS rule, {lit(kind)} AS type, {tpl(title, **parts)} AS title, "
                f"{tpl(detail, **parts)} AS detail, {tpl(action, **parts)} AS action FROM f{where}")

    rules = [
        rule(1, I.TREND_UP, "growth_pct >= 0", g=f1("growth_pct")),
        rule(1, I.TREND_DOWN, "growth_pct < 0", g=f1("abs(growth_pct)")),
        rule(2, I.TOP_PRODUCT, truthy("top_product"), name="top_product", rev=cur("top_product_revenue"),
             share=f1("top_product_share")),
        rule(3, I.WEAK_PRODUCT, truthy("weak_product"), name="weak_product", rev=cur("weak_product_revenue"),
             share=f1("weak_product_share")),
        rule(4, I.TOP_REGION, truthy("top_region"), name="top_region", rev=cur("top_region_revenue"),
             share=f1("top_region_share")),
        rule(5, I.WEAK_REGION, truthy("weak_region"), name="weak_region", rev=cur("weak_region_revenue"),
             share=f1("weak_region_share")),
        rule(6, I.VOLATILE, f"volatility_pct > {I.VOLATILITY_ALERT}", v=f0nan("volatility_pct")),
        rule(6, I.STABLE, f"NOT (volatility_pct > {I.VOLATILITY_ALERT}) OR volatility_pct IS NULL",
             v=f0nan("volatility_pct")),
        rule(7, I.ANOMALIES, "anomaly_count > 0", n="CAST(anomaly_count AS VARCHAR)"),
    ]
    return head + ", rules AS (\n" + "\nUNION ALL ".join(rules) + f"""
)
SELECT {out_keys}CAST(row_number() OVER (PARTITION BY {kl} ORDER BY rule) - 1 AS INTEGER) AS pos,
       type, title, detail, action
FROM rules"""


def forecast_ctes(k: list[str]) -> str:
    """CTE `fsum(keys, best_model, forecast_sum)`: the moving-average forecast of the gap-filled days
    (`a_filled`): the mean of the last seven days at every step of the clamped horizon of 30."""
    kl = ", ".join(k)
    return f""", fs0 AS (SELECT {kl}, y, row_number() OVER (PARTITION BY {kl} ORDER BY ds DESC) AS rd,
                    count(*) OVER (PARTITION BY {kl}) AS n FROM a_filled),
fsum AS (SELECT {kl}, 'Moving Average' AS best_model,
                avg(y) FILTER (rd <= 7) * greatest(3, least(30, greatest(3, max(n) // 4))) AS forecast_sum FROM fs0 GROUP BY {kl})"""


def summary_ctes(keys: list[str], k: list[str], forecast: bool = False) -> str:
    """CTE `s`: headline, summary_text and newline-joined recommendations per segment, with the
    forecast of `fsum` if wanted."""
    kl = ", ".join(k)
    f = (f"ff AS (SELECT f.*, fsum.best_model, fsum.forecast_sum FROM f LEFT JOIN fsum USING ({kl}))" if forecast
         else "ff AS (SELECT * FROM f)")
    bullets = [
        tpl(I.BULLET_TOTAL, x=cur("total_revenue")),
        tpl(I.BULLET_AVERAGE, x=cur("avg_revenue")),
        tpl(I.BULLET_GROWTH, x=f1("growth_pct")),
        f"CASE WHEN {truthy('top_product')} THEN {tpl(I.BULLET_TOP_PRODUCT, name='top_product', x=cur('top_product_revenue'))} END",
        f"CASE WHEN {truthy('top_region')} THEN {tpl(I.BULLET_TOP_REGION, name='top_region', x=cur('top_region_revenue'))} END",
    ]
    if forecast:
        bullets.append(f"CASE WHEN best_model IS NOT NULL THEN {tpl(I.BULLET_FORECAST, model='best_model', x=cur('forecast_sum'))} END")
    recs = [
        (1, "growth_pct < 0", lit(I.REC_GROWTH)),
        (2, f"volatility_pct > {I.VOLATILITY_ALERT}", lit(I.REC_VOLATILITY)),
        (3, truthy("top_product"), tpl(I.REC_TOP_PRODUCT, name="top_product")),
        (4, truthy("top_region"), tpl(I.REC_TOP_REGION, name="top_region")),
        (5, "anomaly_count > 0", lit(I.REC_ANOMALIES)),
    ] + ([(6, "forecast_sum > 0", lit(I.REC_FORECAST))] if forecast else [])
    rec_rows = "\nUNION ALL ".join(f"SELECT {kl}, {n} AS rn, {txt} AS rec FROM ff WHERE {cond}" for n, cond, txt in recs)
    return f""", {f},
rc AS ({rec_rows}),
rc5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {kl} ORDER BY rn) AS o FROM rc) WHERE o <= {I.MAX_RECOMMENDATIONS}),
rj AS (SELECT {kl}, string_agg(rec, chr(10) ORDER BY rn) AS recs, count(*) AS n_recs FROM rc5 GROUP BY {kl}),
s AS (SELECT ff.*, CASE WHEN growth_pct >= 0 THEN {lit(I.HEADLINE_UP)} ELSE {lit(I.HEADLINE_DOWN)} END AS headline,
             concat_ws(' ', {", ".join(bullets)}) AS summary_text,
             COALESCE(rj.recs, {lit(I.REC_DEFAULT)}) AS recommendations_text,
             CAST(COALESCE(rj.n_recs, 1) AS INTEGER) AS n_recommendations
      FROM ff LEFT JOIN rj USING ({kl}))"""


def summary_sql(src_ctes: str, src: str, keys: list[str], forecast: bool = False) -> str:
    head, k = analysis_ctes(src_ctes, src, keys)
    out_keys = "".join(f'"{c}", ' for c in keys)
    return head + (forecast_ctes(k) if forecast else "") + summary_ctes(keys, k, forecast) + f"""
SELECT {out_keys}headline, summary_text, recommendations_text, n_recommendations FROM s"""


def risk_sql(src_ctes: str, src: str, keys: list[str]) -> str:
    kctes, k = kpi_ctes(src, keys)
    from .registry import rnd_sql
    out_keys = "".join(f'"{c}", ' for c in keys)
    return f"""WITH {src_ctes},
{kctes}
SELECT {out_keys}{rnd_sql("growth_pct")} AS growth_pct, {rnd_sql("volatility_pct")} AS volatility_pct,
  CASE WHEN growth_pct < 0 AND volatility_pct > 40 THEN 'High'
       WHEN growth_pct < 0 OR volatility_pct > 35 THEN 'Medium' ELSE 'Low' END AS risk_label,
  CASE WHEN volatility_pct > 40 OR growth_pct < 0 THEN 'elevated' ELSE 'controlled' END AS copilot_risk,
  {rnd_sql("greatest(0.0, 100 - least(100.0, volatility_pct))")} AS stability_pct
FROM kpi"""


def intent_sql(col: str) -> str:
    q = f"lower(trim({col}))"
    whens = []
    for name, phrases in Q.INTENT_RULES:
        cond = " OR ".join(f"contains({q}, {lit(p)})" for p in phrases)
        whens.append(f"WHEN {cond} THEN {lit(name)}")
    return "CASE " + " ".join(whens) + " ELSE 'general' END"


def answers_sql(src_ctes: str, src: str, forecast: bool = False) -> str:
    """Answers to the user turns of `conversations` from the whole-table context."""
    head, k = analysis_ctes(src_ctes, src, [])
    A = Q.ANSWERS
    total = cur("c.total_revenue", True)
    margin = f"{f1('c.margin_pct')} || '%'"
    growth = f"{f1('c.growth_pct')} || '%'"
    vol = f"({f0nan('c.volatility_pct')}) || '%'"
    none = lambda x: f"COALESCE({x}, 'None')"
    tp, tr, wp, wr = none("c.top_product"), none("c.top_region"), none("c.weak_product"), none("c.weak_region")
    # first three recommendations = first three lines of the newline-joined text
    recs3 = "array_to_string(list_slice(string_split(c.recommendations_text, chr(10)), 1, 3), chr(10) || '- ')"
    ans = f"""CASE q.intent
  WHEN 'top_product' THEN {tpl(A['top_product'], tp=tp)}
  WHEN 'weak_product' THEN {tpl(A['weak_product'], wp=wp)}
  WHEN 'top_region' THEN {tpl(A['top_region'], tr=tr)}
  WHEN 'weak_region' THEN {tpl(A['weak_region'], wr=wr)}
  WHEN 'growth' THEN CASE WHEN c.growth_pct >= 0 THEN {tpl(A['growth_up'], growth=growth, total=total)}
                          ELSE {tpl(A['growth_down'], growth=growth)} END
  WHEN 'margin' THEN {tpl(A['margin'], margin=margin)}
  WHEN 'forecast' THEN {tpl(A['forecast'], model='c.best_model', fsum=cur('c.forecast_sum', True)) if forecast
                        else lit(A['forecast_missing'])}
  WHEN 'risk' THEN CASE WHEN c.volatility_pct > 40 OR c.growth_pct < 0 THEN {tpl(A['risk_elevated'], vol=vol, growth=growth)}
                        ELSE {tpl(A['risk_controlled'], vol=vol, growth=growth)} END
  WHEN 'summary' THEN {tpl(A['summary'], headline='c.headline', text='c.summary_text')}
  WHEN 'actions' THEN {tpl(A['actions'], recs=recs3)}
  ELSE {tpl(A['general'], total=total, margin=margin, growth=growth, vol=vol, tp=tp, tr=tr)} END"""
    return head + (forecast_ctes(k) if forecast else "") + summary_ctes([], k, forecast) + f""",
q AS (SELECT conv_id, turn, text, {intent_sql('text')} AS intent FROM conversations WHERE role = 'user')
SELECT q.conv_id, q.turn, q.intent, {ans} AS answer FROM q, s AS c"""
