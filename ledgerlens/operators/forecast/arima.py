"""M4/M5: seasonal ARIMA grid by Hannan–Rissanen least squares, as joins and grouped sums.

Each segment's daily values are one array (bounded by its calendar span). It is joined with the
candidates its length allows, so every later row is one candidate of one segment:

1. A long autoregression per differencing and length gives innovations. Its Gram matrix is a grouped sum
   over products of lags, solved by elimination on arrays.
2. A second regression on lagged values and lagged innovations, again by grouped sums, gives the
   coefficients of each candidate.
3. A fold over the days gives the errors, a fold over the horizon the forecast, and the ψ recursion on
   the product polynomial its interval. The least AIC over days that all candidates share wins by `min_by`.

A candidate that cannot be fitted carries the reason in `error`; if none can, (0, 1, 0) stands in. Seasonal
terms enter as extra lag-7 regressors, not as a multiplicative polynomial (documented deviation from a
state-space maximum-likelihood fit). Everything is JVM expressions; no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...plans.joins import ALL_KEY, drop_seg, seg_keys
from ...session import ensure_checkpoint_dir
from .arrays import computed, let, solved, total, triangle_at
from .base import SARIMAX, Z95, fit_partitions

# The candidate grid, in the reference's order.
ORDERS = [(1, 1, 0), (1, 1, 1), (2, 1, 1), (0, 1, 1), (2, 0, 1)]
SEASONAL_ORDERS = [(1, 1, 1, 7), (1, 1, 0, 7), (0, 1, 1, 7), (0, 0, 0, 0)]
MIN_SEASONAL = 28

SEASON = 7
CANDIDATES = [(i * len(SEASONAL_ORDERS) + j, o, so)
              for i, o in enumerate(ORDERS) for j, so in enumerate(SEASONAL_ORDERS)]
FALLBACK = (1, 1, 1)
FALLBACK_CID = next(cid for cid, o, so in CANDIDATES if o == FALLBACK and not so[3])
#: Stands in where no candidate can be fitted.
WALK_CID = -1
#: Least days of the long autoregression.
LONG_AR = 10
#: Values and errors that a forecast looks back on: lags up to 7, one difference and one seasonal difference.
TAIL = SEASON + 1 + SEASON

MSG_TOO_FEW = "fewer observations than least squares needs"
MSG_NOT_FINITE = "non-finite fit"


def config_text(order, seasonal) -> str:
    return f"order={tuple(order)}, seasonal={tuple(seasonal)}"


def _terms(order, seasonal) -> tuple[list[int], list[int]]:
    (p, _, q), (P, _, Q, s) = order, seasonal
    return list(range(1, p + 1)) + ([s] if P else []), list(range(1, q + 1)) + ([s] if Q else [])


def candidate_rows() -> list[tuple]:
    """(cid, d, D, ar, ma, reach, min_days, loss, extra): `reach` is what the long autoregression must span (0: none
    needed), `loss` the days lost to differencing and lags."""
    out = []
    for cid, order, seasonal in [*CANDIDATES, (WALK_CID, (0, 1, 0), (0, 0, 0, 0))]:
        (p, d, q), (P, D, Q, s) = order, seasonal
        ar, ma = _terms(order, seasonal)
        text = config_text(*CANDIDATES[FALLBACK_CID][1:]) if cid == WALK_CID else config_text(order, seasonal)
        out.append((cid, d, D, ar, ma, max(ma) + max(ar, default=0) if ma else 0, MIN_SEASONAL if s else 0,
                    d + s * D + max(p, q, s if P or Q else 0), text))
    return out


def _difference(x: Column, lag: int) -> Column:
    n = F.greatest(F.size(x) - lag, F.lit(0))
    return F.zip_with(F.slice(x, lag + 1, n), F.slice(x, 1, n), lambda a, b: a - b)


def _differenced(ys: Column, d: Column, D: Column) -> Column:
    return let(F.when(d == 1, _difference(ys, 1)).otherwise(ys),
                lambda w: F.when(D == 1, _difference(w, SEASON)).otherwise(w))


def _gram(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """Per group: `sums`, the upper triangle (row by row) of Σ z zᵀ over the rows' arrays `z` of equal length."""
    pairs = F.flatten(F.transform("z", lambda u, i: F.transform(
        F.slice("z", i + 1, F.size("z") - i), lambda v, j: F.struct(i.alias("i"), (i + j).alias("j"), (u * v).alias("p")))))
    sums = rows.select(*group, F.inline(pairs)).groupBy(*group, "i", "j").agg(F.sum("p").alias("p"))
    return (sums.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("i", "j", "p"))).alias("entries"))
            .select(*group, F.transform("entries", lambda e: e["p"]).alias("sums")))


def _regressed(sums: Column, k: Column) -> Column:
    """The k least-squares coefficients from the triangle of `_gram` over [target, regressors…]; a regressor that
    depends on earlier ones takes no part (coefficient 0)."""
    def at(i, j):
        return triangle_at(sums, k + 1, i, j)
    matrix = F.transform(F.sequence(F.lit(1), k), lambda i: F.transform(
        F.sequence(F.lit(1), k + 1), lambda j: F.when(j <= k, at(i, j)).otherwise(at(F.lit(0), i))))
    return solved(matrix, k, lambda c: at(c + 1, c + 1))


def _polynomial(lags: Column, coefficients: Column, sign: int) -> Column:
    """[1, sign·c₁, …, sign·c₇] with the coefficients at their lags."""
    terms = F.arrays_zip(lags.alias("lag"), coefficients.alias("c"))
    return F.transform(F.sequence(F.lit(0), F.lit(SEASON)), lambda i: F.when(i == 0, F.lit(1.0)).otherwise(
        F.aggregate(terms, F.lit(0.0), lambda s, z: s + F.when(z["lag"] == i, sign * z["c"]).otherwise(F.lit(0.0)))))


def polynomial_product(x: Column, y: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(x) + F.size(y) - 2), lambda k: total(
        F.transform(x, lambda v, i: v * F.coalesce(F.get(y, k - i), F.lit(0.0)))))


def autoregression(ar: Column, a: Column, d: Column, D: Column) -> Column:
    """The coefficients c₁, c₂, … of past values in the next one: 1 − Σ cᵢBⁱ = (1 − Σ aᵢBⁱ)(1 − B)ᵈ(1 − B⁷)ᴰ."""
    seasonal = F.array(*[F.lit(v) for v in (1.0, *[0.0] * (SEASON - 1), -1.0)])
    once = let(_polynomial(ar, a, -1), lambda x: F.when(d == 1, polynomial_product(x, F.array(F.lit(1.0), F.lit(-1.0)))).otherwise(x))
    full = let(once, lambda x: F.when(D == 1, polynomial_product(x, seasonal)).otherwise(x))
    return let(full, lambda x: F.transform(F.slice(x, 2, F.size(x) - 1), lambda v: -v))


def _recent(c: Column, past: Column) -> Column:
    """Σ cᵢ · (the i-th last of `past`)."""
    return total(F.transform(c, lambda v, i: v * F.coalesce(F.get(past, F.size(past) - 1 - i), F.lit(0.0))))


def forecast_path(c: Column, theta: Column, y_tail: Column, e_tail: Column, h: Column) -> Column:
    """h values: each from the values and errors before it, future errors being 0. `theta`: θ₁, θ₂, …"""
    init = F.struct(y_tail.alias("y"), e_tail.alias("e"))

    def step(acc, _):
        return F.struct(F.concat(acc["y"], F.array(_recent(c, acc["y"]) + _recent(theta, acc["e"]))).alias("y"),
                        F.concat(acc["e"], F.array(F.lit(0.0))).alias("e"))
    return F.aggregate(F.sequence(F.lit(1), h), init, step, lambda acc: F.slice(acc["y"], F.size(y_tail) + 1, h))


def psi_weights(c: Column, theta: Column, h: Column) -> Column:
    """ψ₀ = 1, ψⱼ = θⱼ + Σ cᵢ ψⱼ₋ᵢ, the first h of them."""
    def step(psi, j):
        return F.concat(psi, F.array(F.coalesce(F.get(theta, j - 1), F.lit(0.0)) + _recent(c, psi)))
    return F.slice(F.aggregate(F.sequence(F.lit(1), h), F.array(F.lit(1.0)), step), 1, h)


def running_deviation(psi: Column, sigma2: Column) -> Column:
    """√(σ² Σ ψ²) up to each step."""
    sums = F.aggregate(psi, F.array().cast("array<double>"),
                       lambda acc, v: F.concat(acc, F.array(F.coalesce(F.element_at(F.concat(F.array(F.lit(0.0)), acc), -1), F.lit(0.0)) + v * v)))
    return F.transform(sums, lambda s: F.sqrt(sigma2 * s))


def fit_candidates(request: DataFrame, keys: Sequence[str], config: DataFrame | None = None) -> DataFrame:
    """One row a (segment, candidate): its terms, coefficients a and b, sigma2, aic, y_tail, e_tail and `error`.

    With `config` (keys…, cid) a segment gets that candidate alone (and the stand-in)."""
    k = list(keys)
    spark = request.sparkSession
    rows = candidate_rows()
    parts = fit_partitions(spark)
    points = request.groupBy(*k).agg(F.sort_array(F.collect_list(F.struct("t", F.col("y").cast("double").alias("y")))).alias("points"),
                                     F.first("n").alias("n"), F.first("h").alias("h"), F.max("ds").alias("last_ds"))
    series = computed(points, [*k, "n", "h", "last_ds", (F.col("n") >= MIN_SEASONAL).alias("long")],
                       ys=F.transform("points", lambda p: p["y"]))

    # what the candidates regress on: one row a segment, differencing and reach
    kinds = sorted({(r[1], r[2], r[5]) for r in rows})
    kind = F.explode(F.array(*[F.struct(*[F.lit(v).alias(name) for v, name in zip(x, ("d", "D_", "reach"), strict=True)]) for x in kinds]))
    base = series.select(*k, "n", "h", "last_ds", "long", "ys", kind.alias("kind")).select("*", "kind.*").drop("kind")
    base = base.where((F.col("D_") == 0) | F.col("long")).repartition(parts, *k, "d", "D_", "reach")
    base = computed(base, [*k, "n", "h", "last_ds", "long", "d", "D_", "reach", F.slice("ys", -1 * F.least(F.size("ys"), F.lit(TAIL)), TAIL).alias("y_tail")],
                     w=_differenced(F.col("ys"), F.col("d"), F.col("D_")))
    base = base.withColumn("m", F.size("w")).withColumn(
        "L", F.when(F.col("reach") > 0, F.least(F.greatest(F.lit(LONG_AR), F.col("reach")), F.greatest(F.lit(1), F.floor(F.col("m") / 3).cast("int"))))
        .otherwise(F.lit(0)))

    # 1: the long autoregression
    of_kind = [*k, "d", "D_", "reach"]
    lagged = F.transform(F.sequence(F.col("L"), F.col("m") - 1),
                         lambda t: F.struct(F.reverse(F.slice("w", t - F.col("L") + 1, F.col("L") + 1)).alias("z")))
    long_rows = base.where((F.col("L") > 0) & (F.col("m") > F.col("L"))).select(*of_kind, F.inline(lagged))
    size = F.floor((F.sqrt(8.0 * F.size("sums") + 1) - 1) / 2).cast("int") - 1  # regressors of a triangle
    phi = _gram(long_rows, of_kind)
    # a few numbers a segment, which both the regression and the errors need
    ensure_checkpoint_dir(spark)
    phi = computed(phi, of_kind, phi=_regressed(F.col("sums"), size)).checkpoint()
    noise = F.transform("w", lambda x, t: F.when(t >= F.col("L"), x - total(
        F.transform("phi", lambda c, i: c * F.get("w", t - i - 1)))).otherwise(F.lit(0.0)))
    base = base.join(phi, of_kind, "left")
    base = computed(base, [*of_kind, "n", "h", "last_ds", "long", "y_tail", "w", "m", "L"],
                     noise=F.when(F.col("phi").isNotNull(), noise).otherwise(F.transform("w", lambda x: F.lit(0.0))))

    # 2: one row a candidate of a segment, and its regression
    table = spark.createDataFrame([(*r[:6], bool(is_long), r[7], r[8]) for r in rows for is_long in (0, 1) if is_long or not r[6]],
                                  "cid int, d int, D_ int, ar array<int>, ma array<int>, reach int, long boolean, loss int, extra string")
    shared = {is_long: max(r[7] for r in rows if is_long or not r[6]) for is_long in (False, True)}
    fits = base.join(F.broadcast(table), ["d", "D_", "reach", "long"])  # a fixed table of 26 rows
    if config is not None:
        chosen = config.select(*k, F.col("cid").alias("__cid"))
        fits = fits.join(chosen, k).where(F.col("cid").isin(WALK_CID) | (F.col("cid") == F.col("__cid"))).drop("__cid")
    fits = fits.repartition(parts, *k, "cid")
    furthest = F.coalesce(F.array_max(F.concat("ar", "ma")), F.lit(0))
    fits = fits.withColumns({"k": F.size("ar") + F.size("ma"), "start": F.col("L") + furthest})
    fits = fits.withColumn("feasible", (F.col("m") - F.col("start") >= F.col("k") + 1) | (F.col("cid") == WALK_CID))
    of_fit = [*k, "cid"]
    regressors = F.transform(F.sequence(F.col("start"), F.col("m") - 1), lambda t: F.struct(F.concat(
        F.array(F.get("w", t)), F.transform("ar", lambda i: F.get("w", t - i)), F.transform("ma", lambda j: F.get("noise", t - j))).alias("z")))
    fitted = _gram(fits.where("feasible AND k > 0").select(*of_fit, F.inline(regressors)), of_fit)
    fitted = computed(fitted, of_fit, coefficients=_regressed(F.col("sums"), size))
    fits = fits.join(fitted, of_fit, "left").withColumn("coefficients", F.coalesce("coefficients", F.array().cast("array<double>")))
    fits = fits.withColumns({"a": F.slice("coefficients", 1, F.size("ar")), "b": F.slice("coefficients", F.size("ar") + 1, F.size("ma")),
                             "lost": F.col("d") + SEASON * F.col("D_"),
                             "common": F.least(F.when(F.col("long"), shared[True]).otherwise(shared[False]), F.col("n") - 1)})

    # 3: errors of the fitted recursion over all days
    init = F.struct(F.lit(0).alias("t"), F.array_repeat(F.lit(0.0), SEASON).alias("e"), F.lit(0.0).alias("s2"), F.lit(0.0).alias("s2c"))

    def step(acc, x):
        past = F.aggregate(F.arrays_zip(F.col("ar").alias("lag"), F.col("a").alias("c")), F.lit(0.0),
                           lambda s, z: s + z["c"] * F.coalesce(F.get("w", acc["t"] - z["lag"]), F.lit(0.0)))
        noise = F.aggregate(F.arrays_zip(F.col("ma").alias("lag"), F.col("b").alias("c")), F.lit(0.0),
                            lambda s, z: s + z["c"] * F.get(acc["e"], SEASON - z["lag"]))

        def with_error(e):
            return F.struct((acc["t"] + 1).alias("t"), F.concat(F.slice(acc["e"], 2, SEASON - 1), F.array(e)).alias("e"),
                            (acc["s2"] + F.when(acc["t"] >= F.least(F.col("start"), F.col("m") - 1), e * e).otherwise(F.lit(0.0))).alias("s2"),
                            (acc["s2c"] + F.when(acc["t"] + F.col("lost") >= F.col("common"), e * e).otherwise(F.lit(0.0))).alias("s2c"))
        return let(x - past - noise, with_error)
    fits = computed(fits, [*of_fit, "n", "h", "last_ds", "extra", "k", "d", "D_", "ar", "ma", "a", "b", "y_tail", "m", "start", "common", "feasible"],
                     run=F.when(F.col("feasible"), F.aggregate("w", init, step)))
    used = F.greatest(F.col("m") - F.least(F.col("start"), F.col("m") - 1), F.lit(1))
    counted = F.col("n") - F.col("common")
    fits = fits.select(*of_fit, "n", "h", "last_ds", "extra", "d", "D_", "ar", "ma", "a", "b", "y_tail", "feasible",
                       F.col("run.e").alias("e_tail"), F.greatest(F.col("run.s2") / used, F.lit(1e-12)).alias("sigma2"),
                       (counted * F.ln(F.greatest(F.col("run.s2c"), F.lit(1e-300)) / counted) + 2 * (F.col("k") + 1)).alias("aic"))
    finite = F.coalesce(F.abs("sigma2") < float("inf"), F.lit(False)) & F.coalesce(F.abs("aic") < float("inf"), F.lit(False))
    error = F.when(~F.col("feasible"), F.lit(MSG_TOO_FEW)).when(~finite, F.lit(MSG_NOT_FINITE))
    return fits.withColumn("error", error).drop("feasible")


def forecast_fits(fits: DataFrame, keep: Sequence[str]) -> DataFrame:
    """`keep` and the arrays `path` and `deviation` of h steps, from fitted rows alone (no series is read)."""
    c = computed(fits, [*keep, "h", "y_tail", "e_tail", "sigma2"],
                  c=autoregression(F.col("ar"), F.col("a"), F.col("d"), F.col("D_")),
                  theta=F.slice(_polynomial(F.col("ma"), F.col("b"), 1), 2, SEASON))
    return computed(c, keep, path=forecast_path(F.col("c"), F.col("theta"), F.col("y_tail"), F.col("e_tail"), F.col("h")),
                     deviation=let(psi_weights(F.col("c"), F.col("theta"), F.col("h")), lambda p: running_deviation(p, F.col("sigma2"))))


def best_fits(request: DataFrame, keys: Sequence[str], config: DataFrame | None = None) -> DataFrame:
    """The fitted row of least AIC per segment (ties to the earlier candidate), with its `path` and `deviation`, and
    `errors`: what kept other candidates out. A candidate whose forecast is not finite is out as well."""
    k = list(keys)
    fits = fit_candidates(request, k, config)
    state = [c for c in fits.columns if c not in k]
    fits = forecast_fits(fits, [*k, *state])
    finite = F.forall(F.concat("path", "deviation"), lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    fits = fits.withColumn("error", F.when(F.col("error").isNull() & ~finite, F.lit(MSG_NOT_FINITE)).otherwise(F.col("error")))
    good = F.col("error").isNull()
    order = F.when(good, F.struct((F.col("cid") == WALK_CID).alias("last"), F.col("aic"), F.col("cid")))
    columns = [*[c for c in state if c != "error"], "path", "deviation"]
    best = fits.groupBy(*k).agg(F.min_by(F.struct(*columns), order).alias("best"),
                                F.array_sort(F.collect_set(F.when(~good, F.concat_ws(": ", "extra", "error")))).alias("errors"))
    return best.select(*k, "best.*", "errors").withColumn(
        "cid", F.when(F.col("cid") == WALK_CID, FALLBACK_CID).otherwise(F.col("cid")))


def steps_of(forecasts: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row a step: step, ds, forecast, lower, upper."""
    rows = forecasts.select(*keep, "last_ds", F.posexplode(F.arrays_zip("path", "deviation")).alias("pos", "z"))
    fc, sd = F.col("z.path"), F.col("z.deviation")
    return rows.select(*keep, (F.col("pos") + 1).alias("step"), F.date_add("last_ds", F.col("pos") + 1).alias("ds"),
                       fc.alias("forecast"), (fc - Z95 * sd).alias("lower"), (fc + Z95 * sd).alias("upper"))


def arima(request: DataFrame, keys: Sequence[str] = (), config: DataFrame | None = None) -> DataFrame:
    """Backtest/refit SARIMA per segment.

    Without `config` the whole grid is fitted and the lowest AIC wins; with `config`
    (`keys…, cid`) only that candidate is fitted (the refit of a chosen configuration).
    Returns the forecast rows plus `extra` (the configuration text).
    """
    user_keys = list(keys)
    request, keys = seg_keys(request, user_keys)
    if config is not None and not user_keys:
        config = config.withColumn(ALL_KEY, F.lit(0))
    rows = steps_of(best_fits(request, keys, config), [*keys, "extra", "cid", "aic"])
    return drop_seg(rows).select(*user_keys, F.lit(SARIMAX).alias("model"), "step", "ds",
                                 "forecast", "lower", "upper", "extra", "cid", "aic")
