"""Forecast operators against own numpy loops and simple properties."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.forecast import arima as AR
from ledgerlens.operators.forecast import base as B
from ledgerlens.operators.forecast import compare as CM
from ledgerlens.operators.forecast import ets as ET
from ledgerlens.operators.forecast import moving_average as MA
from ledgerlens.operators.forecast import trees as TR

D0 = dt.date(2024, 1, 1)


def _series(spark, ys, key="k"):
    rows = [(key, D0 + dt.timedelta(days=i), float(y)) for i, y in enumerate(ys)]
    return spark.createDataFrame(rows, "seg string, ds date, y double")


def _request(spark, ys, h):
    s = _series(spark, ys)
    return B.with_length(s, ["seg"]).withColumn("h", F.lit(h))


@pytest.mark.parametrize("n,h,expected", [(20, 30, 5), (400, 30, 30), (400, 1, 3), (12, 30, 3)])
def test_horizon_clamp(spark, n, h, expected):
    assert spark.range(1).select(B.clamp_horizon(F.lit(n), h)).first()[0] == expected


def test_moving_average_matches_numpy(spark):
    rng = np.random.default_rng(1)
    ys = rng.uniform(0, 100, 40)
    out = MA.moving_average(_request(spark, ys, 5), ["seg"]).orderBy("step").collect()
    w = 7
    rolling = np.array([ys[max(0, i - w + 1):i + 1].mean() for i in range(len(ys))])
    sigma = np.std(ys - rolling)
    assert [r.forecast for r in out] == pytest.approx([ys[-w:].mean()] * 5)
    assert out[0].upper == pytest.approx(max(0, ys[-w:].mean() + 1.96 * sigma))
    assert out[0].ds == D0 + dt.timedelta(days=40)


def _hw_numpy(ys, a, b, g, seasonal):
    ys = np.asarray(ys, float)
    if seasonal:
        l, tr = ys[:7].mean(), (ys[7:14].mean() - ys[:7].mean()) / 7
        s = list(ys[:7] - ys[:7].mean())
    else:
        l, tr, s, g = ys[0], ys[1] - ys[0], [0.0] * 7, 0.0
    sse = 0.0
    for i, y in enumerate(ys):
        sv = s[i % 7]
        e = y - (l + tr + sv)
        sse += e * e
        nl = a * (y - sv) + (1 - a) * (l + tr)
        tr = b * (nl - l) + (1 - b) * tr
        s[i % 7] = g * (y - nl) + (1 - g) * sv
        l = nl
    return sse, l, tr, s


@pytest.mark.parametrize("n", [20, 60])
def test_ets_matches_numpy_grid(spark, n):
    rng = np.random.default_rng(2)
    t = np.arange(n)
    ys = 50 + 0.5 * t + 10 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 2, n)
    st = ET.ets_state(_request(spark, ys, 3), ["seg"]).first()
    seasonal = n >= ET.MIN_SEASONAL
    grid = [(a, b, g) for a in ET.ALPHAS for b in ET.BETAS for g in (ET.GAMMAS if seasonal else ET.GAMMAS[:1])]
    best = min(grid, key=lambda p: (_hw_numpy(ys, *p, seasonal)[0], p))
    _, l, tr, s = _hw_numpy(ys, *best, seasonal)
    assert (st.alpha, st.beta) == best[:2]
    assert st.level == pytest.approx(l) and st.trend == pytest.approx(tr)
    fc = ET.ets(_request(spark, ys, 3), ["seg"]).orderBy("step").collect()
    assert fc[0].forecast == pytest.approx(l + tr + s[n % 7])


def _hw_sse(ys, x, seasonal):
    a, b, g, l, tr, *s = x
    sse = 0.0
    for i, y in enumerate(ys):
        e = y - (l + tr + s[i % 7])
        sse += e * e
        l, tr = l + tr + a * e, tr + a * b * e
        s[i % 7] += (g * (1 - a) * e if seasonal else 0.0)
    return sse


@pytest.mark.parametrize("n,alpha", [(24, 0.95), (160, 0.95), (160, 0.02)])
def test_refined_ets_is_an_optimum_between_grid_points(spark, n, alpha):
    rng = np.random.default_rng(8)
    l, s, ys = 200.0, 20 * np.sin(2 * np.pi * np.arange(7) / 7) * (n >= 28), []
    for i in range(n):
        e = rng.normal(0, 5)
        ys.append(l + s[i % 7] + e)
        l += alpha * e
    seasonal = n >= ET.MIN_SEASONAL
    req = _request(spark, ys, 3)
    grid, st = ET.ets_state(req, ["seg"]).first(), ET.ets_state(req, ["seg"], refine=True).first()
    base = min(_hw_numpy(ys, a, b, g, seasonal)[0] for a in ET.ALPHAS for b in ET.BETAS for g in ET.GAMMAS)
    assert (st.alpha, st.beta) != (grid.alpha, grid.beta)
    # sigma is the deviation of the one-step errors; the optimum lies below every grid point
    assert st.sigma ** 2 * n < 0.99 * base
    # the start states and parameters of the search: no small change of one lowers the error further
    ys_, x0 = F.array(*[F.lit(float(y)) for y in ys]), [0.3, 0.1, 0.2 * seasonal, ys[0], 0.0] + [0.0] * 7
    x = spark.range(1).select(ET._refined(ys_, F.array(*map(F.lit, x0)), F.lit(float(_hw_sse(ys, x0, seasonal))),
                                          F.lit(seasonal)).alias("x")).first().x
    least = _hw_sse(ys, x, seasonal)
    for i in range(12) if seasonal else (0, 1, 3, 4):
        for d in (-1e-3, 1e-3):
            y = list(x)
            y[i] = min(1.0, max(0.0, y[i] + d)) if i < 3 else y[i] + d
            assert _hw_sse(ys, y, seasonal) > least * (1 - 1e-5), (i, d)


def test_comparison_takes_the_refined_ets(spark):
    rng = np.random.default_rng(9)
    ys = 200 + np.cumsum(rng.normal(0, 5, 90))
    series = _series(spark, ys)
    plan = B.plan_requests(series, ["seg"], 30)
    want = B.score(ET.ets(B.train_request(plan, ["seg"]), ["seg"], refine=True).select("seg", "model", "ds", "forecast"),
                   plan.where(F.col("split") == "test").select("seg", "ds", "y"), ["seg"]).first()
    got = CM.compare_forecasting_models(series, ["seg"], 30, models=("ets",), refit=False).comparison.first()
    assert got.mape == pytest.approx(want.mape)


def test_arima_grid_picks_a_candidate(spark):
    rng = np.random.default_rng(4)
    ys = 100 + np.cumsum(rng.normal(0, 1, 80))
    out = AR.arima(_request(spark, ys, 4), ["seg"]).collect()
    assert len(out) == 4 and len({r.extra for r in out}) == 1 and all(r.lower <= r.upper for r in out)


def test_compare_short_series_uses_moving_average(spark):
    res = CM.compare_forecasting_models(_series(spark, [5.0] * 12), ["seg"], 30, models=("ets",))
    s = res.summary.first()
    assert s.best_model == "Moving Average" and s.message.startswith("Not enough data")
    assert s.horizon == 3 and s.forecast_sum == pytest.approx(15.0)
    assert res.comparison.count() == 0


def test_compare_selects_least_mape(spark):
    rng = np.random.default_rng(5)
    t = np.arange(90)
    ys = 100 + 20 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 1, 90)
    res = CM.compare_forecasting_models(_series(spark, ys), ["seg"], 30, models=("sarimax", "ets"))
    comp = res.comparison.collect()
    best = min(comp, key=lambda r: (r.mape, B.MODEL_ORDER.index(r.model)))
    s = res.summary.first()
    assert s.best_model == best.model and s.horizon == 22
    assert res.forecast.count() == 22
    fc = res.forecast.collect()
    assert all(r.lower <= r.upper for r in fc)


def test_compare_guard_and_bundle(spark, tmp_path):
    two = _series(spark, [1.0, 2.0, 3.0], key="tiny").unionByName(_series(spark, [5.0] * 12, key="short"))
    res = CM.compare_forecasting_models(two, ["seg"], 30, models=("ets",))
    got = {r.seg: r for r in res.summary.collect()}
    assert got["tiny"].best_model == "Not enough data" and got["tiny"].message == CM.MSG_TOO_FEW
    assert got["short"].best_model == "Moving Average"
    assert res.forecast.where(F.col("seg") == "tiny").count() == 0
    CM.write_bundle(res, str(tmp_path / "bundle"), ["seg"])
    assert spark.read.json(str(tmp_path / "bundle")).count() == 2
    ov = CM.forecast_overlay(two, res.forecast, ["seg"])
    assert ov.where(F.col("series") == "forecast").count() == 3


def test_depth_and_bins_of_the_trees_are_arguments(spark):
    for kind in ("forest", "boosting"):
        model = TR._estimator(kind, {"max_depth": 30, "max_bins": 256})
        assert (model.getMaxDepth(), model.getMaxBins()) == (30, 256)
        assert TR._estimator(kind, {}).getMaxBins() == TR.BINS


@pytest.fixture
def many_shuffle_partitions(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, "300")
    yield 300
    spark.conf.set(name, before)


def test_fits_are_dealt_by_cores_not_by_the_shuffle_setting(spark, many_shuffle_partitions):
    request = _request(spark, [float(5 + i % 7) for i in range(40)], 3)
    most = max(B.LEAST_TASKS, B.TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    assert B.fit_partitions(spark) == most < many_shuffle_partitions
    assert ET.ets_state(request, ["seg"], refine=True).rdd.getNumPartitions() <= most
    assert AR.fit_candidates(request, ["seg"]).rdd.getNumPartitions() <= most
    states, nodes = TR.fit_trees(request, ["seg"], "forest", num_trees=2, max_depth=2)
    assert TR.forecast_trees(states, nodes, ["seg"]).rdd.getNumPartitions() <= most
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    assert B.fit_partitions(spark) == 5


def test_forest_draws_do_not_depend_on_how_rows_lie(spark):
    made = np.random.default_rng(1)
    request = _request(spark, (50 + 20 * made.random(1300)).tolist(), 4)
    paths = [[r.forecast for r in TR.forest_forecast(request.repartition(n), ["seg"], num_trees=3, max_depth=4).orderBy("step").collect()]
             for n in (1, 6)]
    assert paths[0] == pytest.approx(paths[1], rel=1e-12)


def test_comparison_reads_its_series_once_and_keeps_nothing(spark):
    reads = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch
    series = _series(spark, [float(10 + i % 5) for i in range(30)])
    series = series.mapInArrow(passed, series.schema).groupBy("seg", "ds").agg(F.sum("y").alias("y"))
    kept = set(spark.sparkContext._jsc.getPersistentRDDs())
    small = {"forest": {"num_trees": 2, "max_depth": 2}, "boosting": {"max_iter": 1}}
    r = CM.compare_forecasting_models(series, ["seg"], 30, tree_params=small)
    assert r.forecast.count() and r.summary.count() == 1
    assert reads.value == 30
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= kept
