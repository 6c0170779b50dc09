"""KPIs, series, anomalies, rule texts and copilot on small frames and driver tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerlens.functions.dates import calendar_columns
from ledgerlens.operators import anomaly as AN
from ledgerlens.operators import insights as I
from ledgerlens.operators import kpi as K
from ledgerlens.operators import questions as Q
from ledgerlens.operators import rollups as RU
from ledgerlens.operators import series as S
from ledgerlens.plans.catalog import clean_sales_view

D0 = dt.date(2024, 1, 1)


def _clean(spark, rows):
    """rows: (day offset, revenue, product, region)"""
    data = [(D0 + dt.timedelta(days=d), float(r), p, g) for d, r, p, g in rows]
    df = spark.createDataFrame(data, "Date date, Revenue double, Product string, Region string")
    return df.withColumn("Quantity", F.lit(1.0)).withColumns(calendar_columns(F.col("Date")))


def test_kpi_single_row(spark):
    k = K.calculate_kpis(_clean(spark, [(0, 100, "p", "r")])).collect()[0]
    assert k.total_revenue == 100 and k.total_records == 1 and k.volatility_pct is None
    assert k.top_product == k.weak_product == "p" and k.growth_pct == 0.0
    assert k.profit == pytest.approx(35.0) and k.margin_pct == pytest.approx(35.0)


def test_kpi_empty_is_zero_record(spark):
    df = _clean(spark, [(0, 1, "p", "r")]).where("false")
    k = K.calculate_kpis(df).collect()
    assert len(k) == 1 and k[0].total_revenue == 0.0 and k[0].top_product is None


def test_growth_branches(spark):
    # 10 days: halves 5/5; previous 0, recent > 0 -> 100
    rows = [(d, 0 if d < 5 else 10, "p", "r") for d in range(10)]
    assert K.calculate_kpis(_clean(spark, rows)).first().growth_pct == 100.0
    # 61 days: last 30 mean 2 vs previous 30 mean 1 -> 100 %
    rows = [(d, 1 if d < 31 else 2, "p", "r") for d in range(61)]
    assert K.calculate_kpis(_clean(spark, rows)).first().growth_pct == pytest.approx(100.0)
    # 9 days: recent == previous -> 0
    rows = [(d, d, "p", "r") for d in range(9)]
    assert K.calculate_kpis(_clean(spark, rows)).first().growth_pct == 0.0


def test_growth_counts_gap_days_as_zero(spark):
    # days 0..9 with revenue only on day 0 and day 9: halves [0..4] mean 1, [5..9] mean 1
    rows = [(0, 5, "p", "r"), (9, 5, "p", "r")]
    assert K.calculate_kpis(_clean(spark, rows)).first().growth_pct == 0.0


def test_top_weak_ties_and_shares(spark):
    rows = [(0, 10, "b", "x"), (1, 10, "a", "x"), (2, 5, "c", "y")]
    k = K.calculate_kpis(_clean(spark, rows)).first()
    assert k.top_product == "a" and k.weak_product == "c"
    assert k.top_product_share == pytest.approx(40.0) and k.unique_products == 3 and k.unique_regions == 2


def test_keyed_equals_union_of_segments(spark):
    rows = [(d % 20, d * 3 % 17 + 1, "p%d" % (d % 3), "r%d" % (d % 2)) for d in range(60)]
    df = _clean(spark, rows)
    keyed = {r.Region: r for r in K.calculate_kpis(df, ["Region"]).collect()}
    for reg in ("r0", "r1"):
        single = K.calculate_kpis(df.where(F.col("Region") == reg)).first()
        assert keyed[reg].total_revenue == pytest.approx(single.total_revenue)
        assert keyed[reg].growth_pct == pytest.approx(single.growth_pct)
        assert keyed[reg].top_product == single.top_product


def test_gap_fill_properties(spark):
    clean = clean_sales_view(spark, SF_SMALL)
    filled = S.gap_fill(S.daily(clean, ["Region"]), ["Region"])
    span = filled.groupBy("Region").agg(F.count("*").alias("c"), F.min("ds").alias("a"), F.max("ds").alias("b"))
    for r in span.collect():
        assert r.c == (r.b - r.a).days + 1
    tot = clean.agg(F.sum("Revenue")).first()[0]
    assert filled.agg(F.sum("y")).first()[0] == pytest.approx(tot)


def test_quartile_and_anomalies(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "y double")
    assert df.agg(F.percentile("y", F.lit(0.25))).first()[0] == 2.25
    rows = [(d, 100, "p", "r") for d in range(20)] + [(20, 1000, "p", "r")]
    an = AN.detect_anomalies(_clean(spark, rows), first_only=False).collect()
    assert [(a.date, a.type) for a in an] == [("2024-01-21", "high")]
    short = [(d, 100 if d != 3 else 1000, "p", "r") for d in range(9)]
    assert AN.detect_anomalies(_clean(spark, short)).count() == 0


def test_weekday_and_heatmap_domains(spark):
    rows = [(0, 10, "p", "r")]  # 2024-01-01 is a Monday
    wk = RU.weekday(_clean(spark, rows)).orderBy("day_pos").collect()
    assert [r.Day for r in wk][0] == "Monday" and len(wk) == 7 and wk[1].Revenue == 0.0
    clean = _clean(spark, rows)
    hm = {r.Day: r for r in RU.heatmap(clean).collect()}
    assert hm["Monday"].Jan == 10.0 and hm["Tuesday"].Jan is None and len(hm) == 7
    assert hm["Monday"].Feb == 0.0
    assert RU.drop_absent_months(RU.heatmap(clean)).columns == ["day_pos", "Day", "Jan"]


def test_insight_order_and_texts(spark):
    rows = [(d, 100 + d, "p%d" % (d % 2), "r") for d in range(12)]
    ins = I.generate_insights(_clean(spark, rows)).orderBy("pos").collect()
    titles = [r.title for r in ins]
    assert titles[0] == "Revenue trend is positive"
    assert titles[1].startswith("Top product: ") and titles[2].startswith("Underperforming product: ")
    assert titles[5] in ("Sales are stable", "Sales are volatile")
    assert ins[1].detail.startswith("Total revenue: $")


def test_summary_recommendations(spark):
    rows = [(d, 100 - d, "p", "r") for d in range(12)]
    s = I.executive_summary(_clean(spark, rows)).first()
    assert s.headline == "Revenue is under pressure."
    assert s.recommendations[0] == I.REC_GROWTH and len(s.recommendations) <= 5
    assert s.summary_text == " ".join(s.bullets)


def test_risk_labels(spark):
    df = spark.createDataFrame([(-1.0, 41.0), (1.0, 36.0), (1.0, 35.0), (1.0, None)],
                               "growth_pct double, volatility_pct double")
    got = [(r.risk_label, r.copilot_risk) for r in K.risk_columns(df).collect()]
    assert got == [("High", "elevated"), ("Medium", "controlled"), ("Low", "controlled"), ("Low", "controlled")]


@pytest.mark.parametrize("question,intent", [
    ("Which region needs attention?", "top_region"),
    ("Which product is performing best?", "general"),
    ("any unstable weeks?", "risk"),
    ("How many transactions?", "actions"),
    ("Show me the forecast outlook.", "forecast"),
])
def test_intents(spark, question, intent):
    df = spark.createDataFrame([(question,)], "q string")
    assert df.select(Q.intent(F.col("q"))).first()[0] == intent


def test_answers_use_context(spark):
    clean = _clean(spark, [(d, 100 + d, "p", "r") for d in range(12)])
    ctx = Q.chat_context(clean)
    qs = spark.createDataFrame([(1, "what is the trend?"), (2, "what should I do?"), (3, "hello")], "id int, text string")
    ans = {r.id: r.answer for r in Q.answer_questions(qs, ctx).collect()}
    assert ans[1].startswith("Revenue is trending upward with **")
    assert ans[2].startswith("Recommended actions:\n- ")
    assert ans[3].startswith("Here is the current business snapshot:\n- Total revenue: $ ")


def test_last_turns(spark):
    conv = spark.createDataFrame([(1, t, "user", str(t)) for t in range(15)], "conv_id int, turn int, role string, text string")
    assert sorted(r.turn for r in Q.last_turns(conv).collect()) == list(range(5, 15))


def test_normalize_kpis_fallbacks(spark):
    k = K.normalize_kpis(K.calculate_kpis(_clean(spark, [(0, 10, "p", "r")]))).first()
    assert k.margin == pytest.approx(35.0) and k.unique_items == 1 and k.top_product_value == 10.0
