"""ARIMA by joins and grouped sums against the plain loop of `numpy_arima`."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

import numpy_arima as NA
from ledgerlens.operators.forecast import arima as AR
from ledgerlens.operators.forecast import base as B

D0 = dt.date(2024, 1, 1)


def series(kind, n, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    if kind == "walk":
        return 100 + np.cumsum(rng.normal(0, 1, n))
    if kind == "weekly":
        return 1e6 + 3e5 * np.sin(2 * np.pi * t / 7) + np.cumsum(rng.normal(0, 1e4, n))
    return rng.uniform(0, 100, n) * (rng.uniform(size=n) < 0.6)  # many days without sales


def request(spark, data, h=6):
    rows = [(key, D0 + dt.timedelta(days=i), float(y)) for key, ys in data.items() for i, y in enumerate(ys)]
    df = spark.createDataFrame(rows, "seg string, ds date, y double")
    return B.with_length(df, ["seg"]).withColumn("h", F.lit(h))


def test_every_candidate_equals_the_plain_loop(spark):
    data = {f"{kind}{n}": series(kind, n) for kind in ("walk", "weekly", "gaps") for n in (21, 40, 150)}
    req = request(spark, data)
    fits = AR.fit_candidates(req, ["seg"])
    state = [c for c in fits.columns if c != "seg"]
    got = AR.forecast_fits(fits, ["seg", *state]).collect()
    assert len(got) == 9 + sum(len(NA.candidates(len(ys))) for ys in data.values())  # one row a candidate, and the stand-in
    order = {cid: (o, so) for cid, o, so in AR.CANDIDATES} | {AR.WALK_CID: ((0, 1, 0), (0, 0, 0, 0))}
    for r in got:
        try:
            fc, sd, aic = NA.fit_forecast(data[r.seg], *order[r.cid], 6)
        except ValueError:
            assert r.error is not None
            continue
        assert r.error is None
        assert r.aic == pytest.approx(aic, rel=1e-6), (r.seg, r.cid)
        assert r.path == pytest.approx(fc, rel=1e-5), (r.seg, r.cid)
        assert r.deviation == pytest.approx(sd, rel=1e-5), (r.seg, r.cid)


def test_best_candidate_and_refit(spark):
    data = {kind: series(kind, 120, 3) for kind in ("walk", "weekly", "gaps")}
    req = request(spark, data)
    out = AR.arima(req, ["seg"]).orderBy("seg", "step").collect()
    for seg, ys in data.items():
        cid, fc, sd, aic = NA.fit_best(ys, 6)
        rows = [r for r in out if r.seg == seg]
        assert {r.cid for r in rows} == {cid} and [r.forecast for r in rows] == pytest.approx(fc, rel=1e-5)
        assert [r.upper - r.forecast for r in rows] == pytest.approx(1.96 * sd, rel=1e-5)
        assert rows[0].ds == D0 + dt.timedelta(days=120) and rows[0].extra == AR.config_text(*AR.CANDIDATES[cid][1:])
    config = spark.createDataFrame([("walk", 5), ("gaps", 11)], "seg string, cid int")
    refit = {r.seg: r for r in AR.arima(req, ["seg"], config).where("step = 1").collect()}
    assert set(refit) == {"walk", "gaps"}
    for seg, cid in (("walk", 5), ("gaps", 11)):
        fc, _, _ = NA.fit_forecast(data[seg], *AR.CANDIDATES[cid][1:], 6)
        assert refit[seg].forecast == pytest.approx(fc[0], rel=1e-5)


def test_recovers_an_ar_coefficient(spark):
    rng = np.random.default_rng(3)
    n, phi = 600, 0.6
    e, w = rng.normal(0, 1, n), np.zeros(n)
    for t in range(1, n):
        w[t] = phi * w[t - 1] + e[t]
    y = np.cumsum(w) + 100          # ARIMA(1,1,0)
    fit = AR.fit_candidates(request(spark, {"x": y}), ["seg"]).where("cid = 3").first()
    assert AR.CANDIDATES[3][1:] == ((1, 1, 0), (0, 0, 0, 0))
    assert fit.a == pytest.approx([phi], abs=0.07) and fit.sigma2 == pytest.approx(1.0, abs=0.15)


def test_prefers_seasonal_terms_on_weekly_data(spark):
    best = AR.best_fits(request(spark, {"x": series("weekly", 200)}), ["seg"]).first()
    assert AR.CANDIDATES[best.cid][2][3] == 7


@pytest.mark.parametrize("ys", [[5.0] * 30, [1.0, 2.0], [0.0] * 5, [4.0]])
def test_degenerate_series_get_a_forecast(spark, ys):
    rows = AR.arima(request(spark, {"x": ys}, 3), ["seg"]).collect()
    assert len(rows) == 3 and all(np.isfinite([r.forecast, r.lower, r.upper]).all() for r in rows)
    if len(set(ys)) == 1:
        assert [r.forecast for r in rows] == pytest.approx([ys[0]] * 3, abs=1e-6)


def test_polynomials_and_intervals_against_loops(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=4), rng.normal(size=6)
    c, theta, h = rng.normal(0, 0.3, 15), rng.normal(0, 0.3, 7), 12

    def lit(v):
        return F.array(*[F.lit(float(a)) for a in v])
    r = spark.range(1).select(AR.polynomial_product(lit(x), lit(y)).alias("p"), AR.psi_weights(lit(c), lit(theta), F.lit(h)).alias("psi"),
                              AR.running_deviation(lit(x), F.lit(2.0)).alias("sd")).first()
    assert r.p == pytest.approx(np.convolve(x, y))
    psi = [1.0]
    for j in range(1, h):
        psi.append((theta[j - 1] if j <= 7 else 0.0) + sum(c[i] * psi[j - 1 - i] for i in range(min(j, 15))))
    assert r.psi == pytest.approx(psi) and r.sd == pytest.approx(np.sqrt(2.0 * np.cumsum(x ** 2)))


def test_no_python_and_no_group_of_several_candidates(spark):
    plan = AR.arima(request(spark, {"x": series("walk", 60)}), ["seg"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
