"""M6: additive Holt–Winters (trend, + weekly season when n ≥ 28) as folds over arrays.

Each segment's training values become one array (bounded by its calendar span); the
array is paired with a fixed smoothing-parameter grid by `explode` of a literal array,
the level/trend/season recursion runs as a higher-order `aggregate` with a struct state,
and the grid point with the least one-step SSE wins. With `refine`, a damped Gauss–Newton search
goes on from that point over the smoothing parameters and the start states: its fold carries the
derivatives of level, trend and season, so one pass over the series gives the SSE, its gradient and
its normal matrix. A segment whose search ends without an optimum is flagged. No Python runs on the
executors.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import computed, dot, let, solved, total, triangle_at
from .base import ETS, band, fit_partitions

SEASON = 7
MIN_SEASONAL = 28
# Smoothing-parameter grid (level α, trend β, season γ): the start of the search.
ALPHAS = [0.1, 0.3, 0.5, 0.8]
BETAS = [0.01, 0.1, 0.3]
GAMMAS = [0.05, 0.2, 0.5]
# The search ends when the errors are orthogonal to every derivative (the largest cosine is below ORTHOGONAL), or when
# a step lowers the SSE, and promised to lower it, by no more than the share LEAST_FALL; a segment that needs more passes over its series, or finds no lower SSE at any damping, is flagged as not converged.
ORTHOGONAL = 1e-6
LEAST_FALL = 1e-9
MOST_PASSES = 300
MOST_DAMPING = 1e10
PARAMETERS = 5 + SEASON


def _mean(arr: F.Column) -> F.Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / F.size(arr)


def _sse(ys: F.Column, p: F.Column) -> F.Column:
    """One-step SSE of [α, β, γ, level, trend, 7 seasons], in error-correction form."""
    a, b, g = (F.element_at(p, i) for i in (1, 2, 3))
    init = F.struct(F.element_at(p, 4).alias("l"), F.element_at(p, 5).alias("b"), F.slice(p, 6, SEASON).alias("s"),
                    F.lit(0.0).alias("sse"))

    def step(acc, y):
        def corrected(e):
            season = F.element_at(acc["s"], 1) + g * (1 - a) * e
            return F.struct((acc["l"] + acc["b"] + a * e).alias("l"), (acc["b"] + a * b * e).alias("b"),
                            F.concat(F.slice(acc["s"], 2, SEASON - 1), F.array(season)).alias("s"),
                            (acc["sse"] + e * e).alias("sse"))
        return let(y - (acc["l"] + acc["b"] + F.element_at(acc["s"], 1)), corrected)
    return F.aggregate(ys, init, step, lambda acc: acc["sse"])


def _errors(ys: Column, p: Column) -> Column:
    """At `p` (see `_sse`): sse, gradient (Σ e ∂e/∂pᵢ) and normal (the triangle of Σ ∂e/∂pᵢ ∂e/∂pⱼ), in one pass."""
    a, b, g = (F.element_at(p, i) for i in (1, 2, 3))

    # the places of the triangle, as one constant
    pairs = F.from_json(F.lit(json.dumps([{"i": i, "j": j} for i in range(PARAMETERS) for j in range(i, PARAMETERS)])),
                        "array<struct<i: int, j: int>>")

    def unit(i):
        return F.array(*[F.lit(1.0 if j == i else 0.0) for j in range(PARAMETERS)])
    init = F.struct(F.element_at(p, 4).alias("l"), F.element_at(p, 5).alias("b"), F.slice(p, 6, SEASON).alias("s"),
                    unit(3).alias("dl"), unit(4).alias("db"), F.array(*[unit(5 + i) for i in range(SEASON)]).alias("ds"),
                    F.lit(0.0).alias("sse"), F.array_repeat(F.lit(0.0), PARAMETERS).alias("gradient"),
                    F.array_repeat(F.lit(0.0), PARAMETERS * (PARAMETERS + 1) // 2).alias("normal"))

    def step(acc, y):
        def with_error(e):
            dl, db, ds = acc["dl"], acc["db"], F.element_at(acc["ds"], 1)

            def with_derivative(de):
                def moved(start, gain, own):  # start + gain · de, and what the parameters themselves add
                    return F.transform(start, lambda v, i: v + gain * F.get(de, i) + own(i))
                level = moved(F.zip_with(dl, db, lambda u, v: u + v), a, lambda i: F.when(i == 0, e).otherwise(F.lit(0.0)))
                trend = moved(db, a * b, lambda i: F.when(i == 0, b * e).when(i == 1, a * e).otherwise(F.lit(0.0)))
                season = moved(ds, g * (1 - a), lambda i: F.when(i == 0, -g * e).when(i == 2, (1 - a) * e).otherwise(F.lit(0.0)))
                return F.struct(
                    (acc["l"] + acc["b"] + a * e).alias("l"), (acc["b"] + a * b * e).alias("b"),
                    F.concat(F.slice(acc["s"], 2, SEASON - 1), F.array(F.element_at(acc["s"], 1) + g * (1 - a) * e)).alias("s"),
                    level.alias("dl"), trend.alias("db"), F.concat(F.slice(acc["ds"], 2, SEASON - 1), F.array(season)).alias("ds"),
                    (acc["sse"] + e * e).alias("sse"), F.zip_with(acc["gradient"], de, lambda u, v: u + e * v).alias("gradient"),
                    F.zip_with(acc["normal"], pairs, lambda u, ij: u + F.get(de, ij["i"]) * F.get(de, ij["j"])).alias("normal"))
            return let(F.transform(dl, lambda v, i: -(v + F.get(db, i) + F.get(ds, i))), with_derivative)
        return let(y - (acc["l"] + acc["b"] + F.element_at(acc["s"], 1)), with_error)
    return F.aggregate(ys, init, step, lambda acc: F.struct(acc["sse"].alias("sse"), acc["gradient"].alias("gradient"),
                                                            acc["normal"].alias("normal")))


def _searched(ys: Column, start: Column, seasonal: Column) -> Column:
    """(p, sse, converged, passes): Levenberg–Marquardt steps from `start`, the smoothing parameters kept in [0, 1].

    The errors are linear in the start states, so only the smoothing parameters' steps are damped; the damping
    follows how much of the predicted fall a step brings. A parameter at its bound whose gradient points outwards
    stays; without a season γ and the seasonal states stay 0."""
    n = F.lit(PARAMETERS)

    def diagonal(at, i):
        return triangle_at(at["normal"], n, i, i)

    def free(p, at, i):
        v, slope = F.get(p, i), F.get(at["gradient"], i)
        bound = (i < 3) & (((v <= 0) & (slope > 0)) | ((v >= 1) & (slope < 0)))
        return (seasonal | i.isin(0, 1, 3, 4)) & ~bound & (diagonal(at, i) > 0)

    def orthogonal(p, at):
        """No free parameter's derivative has a component along the errors."""
        return (at["sse"] <= 0) | ~F.exists(F.sequence(F.lit(0), n - 1), lambda i: free(p, at, i) & (
            F.abs(F.get(at["gradient"], i)) > ORTHOGONAL * F.sqrt(diagonal(at, i) * at["sse"])))

    def proposed(p, at, damping):
        def with_free(who):
            rows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(F.lit(0), n), lambda j: F.when(
                ~F.get(who, i), F.when(i == j, F.lit(1.0)).otherwise(F.lit(0.0)))
                .when(j == n, -F.get(at["gradient"], i)).when(i == j, diagonal(at, i) * F.when(i < 3, 1 + damping).otherwise(1.0))
                .when(F.get(who, j), triangle_at(at["normal"], n, i, j)).otherwise(F.lit(0.0))))
            step = solved(rows, n, lambda c: F.when(F.get(who, c), diagonal(at, c)).otherwise(F.lit(1.0)))
            return F.zip_with(p, step, lambda v, d: v + d)
        moved = let(F.transform(F.sequence(F.lit(0), n - 1), lambda i: free(p, at, i)), with_free)
        return F.transform(moved, lambda v, i: F.when(i < 3, F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))).otherwise(v))

    def state(p, at, damping, growth, passes, flat):
        return let(flat | orthogonal(p, at), lambda done: F.struct(
            p.alias("p"), at.alias("at"), damping.alias("damping"), growth.alias("growth"), passes.alias("passes"),
            done.alias("converged"), (~done & (damping < MOST_DAMPING)).alias("live")))

    def predicted(at, d):
        """The fall of the SSE that the quadratic model promises for the step d."""
        bend = F.transform(d, lambda v, i: v * total(F.transform(d, lambda u, j: u * triangle_at(at["normal"], n, i, j))))
        return -2 * dot(at["gradient"], d) - total(bend)

    def step(acc, _):
        def judged(trial):
            fall = acc["at"]["sse"] - trial["at"]["sse"]
            d = F.zip_with(trial["p"], acc["p"], lambda u, v: u - v)

            def moved(promised):
                ratio = F.least(F.coalesce(F.try_divide(fall, promised), F.lit(1.0)), F.lit(1.0))
                flat = F.greatest(fall, promised) <= LEAST_FALL * acc["at"]["sse"]
                shrink = F.greatest(F.lit(1 / 3), 1 - (2 * ratio - 1) * (2 * ratio - 1) * (2 * ratio - 1))
                return state(trial["p"], trial["at"], F.greatest(acc["damping"] * shrink, F.lit(1e-12)), F.lit(2.0), acc["passes"] + 1, flat)
            return F.when(fall > 0, let(predicted(acc["at"], d), moved)).otherwise(state(
                acc["p"], acc["at"], acc["damping"] * acc["growth"], acc["growth"] * 2, acc["passes"] + 1, F.lit(False)))
        tried = let(proposed(acc["p"], acc["at"], acc["damping"]),
                    lambda p: F.struct(p.alias("p"), _errors(ys, p).alias("at")))
        return F.when(acc["live"], let(tried, judged)).otherwise(acc)
    begin = let(_errors(ys, start), lambda at: state(start, at, F.lit(1e-3), F.lit(2.0), F.lit(1), F.lit(False)))
    return F.aggregate(F.sequence(F.lit(2), F.lit(MOST_PASSES)), begin, step, lambda acc: F.struct(
        acc["p"].alias("p"), acc["at"]["sse"].alias("sse"), acc["converged"].alias("converged"), acc["passes"].alias("passes")))


def _refined(ys: Column, start: Column, sse: Column, seasonal: Column) -> Column:
    """The parameters and start states that `_searched` finds."""
    return F.when(sse > 0, _searched(ys, start, seasonal)["p"]).otherwise(start)


def ets_state(request: DataFrame, keys: Sequence[str], refine: bool = False) -> DataFrame:
    """Fitted final state per segment: level, trend, season array, residual σ, chosen (α, β, γ).

    `refine` searches on from the best grid point and adds the series, what was found (start, sse), whether it is
    an optimum (converged) and how many passes it took; without it the grid point stands, which is what the SQL
    of `ets_grid_forecast` states."""
    keys = list(keys)
    parts = fit_partitions(request.sparkSession)
    pts = request.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("t", "y"))).alias("__pts"),
        F.first("n").alias("n"), F.first("h").alias("h"), F.max("ds").alias("last_ds"))
    ys = F.transform(F.col("__pts"), lambda p: p["y"].cast("double"))
    seasonal = F.col("n") >= MIN_SEASONAL
    wk1, wk2 = F.slice(ys, 1, SEASON), F.slice(ys, SEASON + 1, SEASON)
    l0 = F.when(seasonal, _mean(wk1)).otherwise(F.element_at(ys, 1))
    b0 = (F.when(seasonal, (_mean(wk2) - _mean(wk1)) / SEASON)
          .when(F.col("n") >= 2, F.element_at(ys, 2) - F.element_at(ys, 1)).otherwise(F.lit(0.0)))
    s0 = F.when(seasonal, F.transform(wk1, lambda x: x - _mean(wk1))) \
        .otherwise(F.array_repeat(F.lit(0.0), SEASON))
    grid = F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta"), F.lit(g).alias("gamma"))
                     for a, b, g in product(ALPHAS, BETAS, GAMMAS)])
    fan = (pts.select(*keys, "n", "h", "last_ds", ys.alias("ys"), l0.alias("l0"), b0.alias("b0"),
                      s0.alias("s0"), seasonal.alias("seasonal"), F.explode(grid).alias("p"))
           # without a season γ is irrelevant: keep one γ per (α, β)
           .where(F.col("seasonal") | (F.col("p.gamma") == GAMMAS[0])))
    fan = fan.repartition(parts)
    a, b = F.col("p.alpha"), F.col("p.beta")
    g = F.when(F.col("seasonal"), F.col("p.gamma")).otherwise(F.lit(0.0))

    init = F.struct(F.col("l0").cast("double").alias("l"), F.col("b0").cast("double").alias("b"),
                    F.col("s0").alias("s"), F.lit(0).alias("i"),
                    F.lit(0.0).alias("sse"), F.lit(0.0).alias("se"))

    def step(acc, y):
        idx = acc["i"] % SEASON
        sv = F.element_at(acc["s"], idx + 1)
        err = y - (acc["l"] + acc["b"] + sv)
        lvl = a * (y - sv) + (1 - a) * (acc["l"] + acc["b"])
        trend = b * (lvl - acc["l"]) + (1 - b) * acc["b"]
        snew = g * (y - lvl) + (1 - g) * sv
        season = F.transform(acc["s"], lambda x, j: F.when(j == idx, snew).otherwise(x))
        return F.struct(lvl.alias("l"), trend.alias("b"), season.alias("s"), (acc["i"] + 1).alias("i"),
                        (acc["sse"] + err * err).alias("sse"), (acc["se"] + err).alias("se"))

    start = ["ys", "l0", "b0", "s0", "seasonal"] if refine else []
    fitted = fan.select(*keys, "n", "h", "last_ds", *start, "p", F.aggregate("ys", init, step).alias("st"))
    best = fitted.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("n", "h", "last_ds", *start)],
        F.min_by(F.struct("p", "st"),
                 F.struct(F.col("st.sse"), F.col("p.alpha"), F.col("p.beta"), F.col("p.gamma"))).alias("w"))
    kept = []
    if refine:
        at = F.concat(F.array("w.p.alpha", "w.p.beta", F.when(F.col("seasonal"), F.col("w.p.gamma")).otherwise(F.lit(0.0)),
                              F.col("l0").cast("double"), F.col("b0").cast("double")), "s0")
        found = computed(best.withColumn("x", at).repartition(parts), [*keys, "n", "h", "last_ds", "ys", "seasonal"],
                         found=_searched(F.col("ys"), F.col("x"), F.col("seasonal")))
        x = F.col("found.p")
        point = F.struct(*[F.element_at(x, i + 1).alias(name) for i, name in enumerate(("alpha", "beta", "gamma"))])
        kept = ["ys", "seasonal", "start", "sse", "converged", "passes"]
        found = found.select(*keys, "n", "h", "last_ds", "ys", "seasonal", point.alias("p"), F.element_at(x, 4).alias("l0"),
                             F.element_at(x, 5).alias("b0"), F.slice(x, 6, SEASON).alias("s0"), x.alias("start"), "found.sse",
                             "found.converged", "found.passes")
        best = found.select(*keys, "n", "h", "last_ds", *kept, F.struct("p", F.aggregate("ys", init, step).alias("st")).alias("w"))
    nn = F.col("n").cast("double")
    var = F.col("w.st.sse") / nn - (F.col("w.st.se") / nn) * (F.col("w.st.se") / nn)
    if not refine:
        best, kept = best.withColumn("grid_sse", F.col("w.st.sse")), ["grid_sse"]
    return best.select(*keys, "n", "h", "last_ds", F.col("w.st.l").alias("level"), F.col("w.st.b").alias("trend"),
                       F.col("w.st.s").alias("season"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sigma"),
                       F.col("w.p.alpha").alias("alpha"), F.col("w.p.beta").alias("beta"),
                       F.col("w.p.gamma").alias("gamma"), *kept)


def optimality(request: DataFrame, keys: Sequence[str] = (), share: float = 1e-3) -> DataFrame:
    """Per segment what `refine` found, tested from outside: sse, grid_sse (of the best grid point), converged, and
    least_nearby, the least SSE after moving one parameter or start state by `share` (of 1, or of the errors' size)."""
    keys = list(keys)
    fit = ets_state(request, keys, refine=True)
    size = F.sqrt(F.col("sse") / F.size("ys"))
    moves = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(PARAMETERS - 1)), lambda i: F.array(
        *[F.struct(i.alias("i"), (sign * share * F.when(i < 3, F.lit(1.0)).otherwise(size)).alias("by")) for sign in (-1, 1)])))
    moves = F.filter(moves, lambda m: F.col("seasonal") | m["i"].isin(0, 1, 3, 4))
    nearby = F.transform(moves, lambda m: let(F.transform("start", lambda v, i: F.when(i != m["i"], v).when(
        i < 3, F.least(F.greatest(v + m["by"], F.lit(0.0)), F.lit(1.0))).otherwise(v + m["by"])), lambda p: _sse(F.col("ys"), p)))
    grid = ets_state(request, keys).select(*keys, "grid_sse")
    return fit.select(*keys, "sse", "converged", "passes", F.array_min(nearby).alias("least_nearby")).join(grid, keys)


def steps_of(states: DataFrame, keep: Sequence[str]) -> DataFrame:
    """keep…, step, ds, forecast, lower, upper: l + k·b + s[(n+k−1) mod 7], the band clipped at 0 (the point is not)."""
    out = states.select(*keep, "n", "last_ds", "level", "trend", "season", "sigma",
                        F.explode(F.sequence(F.lit(1), F.col("h"))).alias("step"))
    sidx = ((F.col("n") + F.col("step") - 1) % SEASON) + 1
    fc = F.col("level") + F.col("step") * F.col("trend") + F.element_at(F.col("season"), sidx.cast("int"))
    lo, hi = band(fc, F.col("sigma"))
    return out.select(*keep, "step", F.date_add("last_ds", F.col("step")).alias("ds"),
                      fc.alias("forecast"), lo.alias("lower"), hi.alias("upper"))


def ets(request: DataFrame, keys: Sequence[str] = (), refine: bool = False) -> DataFrame:
    """The forecast rows of `ets_state`."""
    keys = list(keys)
    rows = steps_of(ets_state(request, keys, refine), keys)
    return rows.select(*keys, F.lit(ETS).alias("model"), "step", "ds", "forecast", "lower", "upper")
