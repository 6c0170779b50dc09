"""S8 + M14: fitted models as rows, kept by run, that forecast again without the series.

A state is one row a segment and model: what its forecast needs and nothing else (ARIMA: coefficients and the
last values and errors; ETS: level, trend and season; trees: the scaled history and the model's node arrays;
moving average: the level). `forecast_states` turns states into forecast rows, so a backtest, a refit and a
forecast from the store all run the same code.

A store is a folder with `states` and `nodes`, both in folders by run; a run only adds its own.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arima as AR
from . import ets as ET
from . import moving_average as MA
from . import trees as TR
from .base import BOOSTING, ETS, FOREST, MOVING_AVERAGE, SARIMAX

#: What each kind of model keeps.
PARTS = {
    "arima": "struct<d: int, D_: int, ar: array<int>, ma: array<int>, a: array<double>, b: array<double>, "
             "y_tail: array<double>, e_tail: array<double>, sigma2: double>",
    "ets": "struct<n: int, level: double, trend: double, season: array<double>, sigma: double>",
    "trees": "struct<kind: string, lags: int, scale: double, sigma: double, hist: array<double>, model_id: string>",
    "average": "struct<level: double, sigma: double>",
}


@dataclass
class Fitted:
    """states: keys…, model, extra, h, last_ds and the four parts; nodes: the tree models' arrays."""
    states: DataFrame
    nodes: DataFrame


def _state(keys: list[str], frame: DataFrame, model: Column, extra: Column, part: str) -> DataFrame:
    names = [field.split(":")[0].strip() for field in PARTS[part].removeprefix("struct<").removesuffix(">").split(", ")]
    parts = [(F.struct(*names) if p == part else F.lit(None)).cast(t).alias(p) for p, t in PARTS.items()]
    return frame.select(*keys, model.alias("model"), extra.alias("extra"), F.col("h").cast("int").alias("h"), "last_ds", *parts)


def fit(name: str, request: DataFrame, keys: Sequence[str], config: DataFrame | None = None, lags: DataFrame | None = None,
        save_to: str | None = None, **params) -> Fitted:
    """The states of one model (`sarimax`, `ets`, `forest`, `boosting` or `average`) on a request; a segment that it
    cannot be fitted to has none."""
    k = list(keys)
    nodes = request.sparkSession.createDataFrame([], TR.NODES)
    if name == "sarimax":
        best = AR.best_fits(request, k, config).where(F.col("cid").isNotNull())
        return Fitted(_state(k, best, F.lit(SARIMAX), F.col("extra"), "arima"), nodes)
    if name == "ets":
        found = ET.ets_state(request, k, refine=True)
        note = F.when(F.col("converged"), F.lit("seasonal=auto")).otherwise(F.lit("seasonal=auto, not converged"))
        return Fitted(_state(k, found, F.lit(ETS), note, "ets"), nodes)
    if name in ("forest", "boosting"):
        states, nodes = TR.fit_trees(request, k, name, lags, save_to, **params)
        note = F.concat(F.lit("lags="), F.col("lags").cast("string"))
        return Fitted(_state(k, states, F.lit(FOREST if name == "forest" else BOOSTING), note, "trees"), nodes)
    if name == "average":
        return Fitted(_state(k, MA.average_state(request, k), F.lit(MOVING_AVERAGE), F.lit(""), "average"), nodes)
    raise ValueError(name)


def together(parts: Sequence[Fitted]) -> Fitted:
    out = parts[0]
    for p in parts[1:]:
        out = Fitted(out.states.unionByName(p.states), out.nodes.unionByName(p.nodes))
    return out


def forecast_states(fitted: Fitted, keys: Sequence[str]) -> DataFrame:
    """keys…, model, extra, step, ds, forecast, lower, upper from states alone, whatever models they are of."""
    k = list(keys)
    columns = [*k, "model", "extra", "step", "ds", "forecast", "lower", "upper"]
    base = [*k, "model", "extra", "h", "last_ds"]

    def of(part: str) -> DataFrame:
        return fitted.states.where(F.col(part).isNotNull()).select(*base, f"{part}.*")
    arima = AR.steps_of(AR.forecast_fits(of("arima"), [*k, "model", "extra", "last_ds"]), [*k, "model", "extra"])
    ets = ET.steps_of(of("ets"), [*k, "model", "extra"])
    trees = TR.forecast_trees(of("trees").drop("model", "extra"), fitted.nodes, k)
    average = MA.steps_of(of("average"), [*k, "model", "extra"])
    out = arima.select(*columns)
    for more in (ets, trees, average):
        out = out.unionByName(more.select(*columns))
    return out


def save(fitted: Fitted, path: str, summary: DataFrame | None = None, keys: Sequence[str] = (), run_id: str | None = None) -> str:
    """Adds a run to the store at `path` (a shared folder); returns its identifier, which sorts by time."""
    run_id = run_id or new_run()
    saved = fitted.states.withColumn("saved_at", F.current_timestamp())
    if summary is not None:
        saved = saved.join(summary, list(keys), "left")
    for name, rows in (("states", saved), ("nodes", fitted.nodes)):
        rows.write.parquet(f"{path.rstrip('/')}/{name}/run_id={run_id}")
    return run_id


def new_run() -> str:
    return dt.datetime.now(dt.UTC).strftime("%Y%m%dT%H%M%S%f") + "-" + uuid.uuid4().hex[:8]


def latest(spark: SparkSession, path: str, keys: Sequence[str], run_id: str | None = None) -> Fitted:
    """Per segment the state of its latest run (or of `run_id`), and the node arrays those states name."""
    k = list(keys)
    states = spark.read.parquet(f"{path.rstrip('/')}/states").withColumn("run_id", F.col("run_id").cast("string"))
    nodes = spark.read.parquet(f"{path.rstrip('/')}/nodes").drop("run_id")
    if run_id is not None:
        states = states.where(F.col("run_id") == run_id)
    columns = [c for c in states.columns if c not in k]
    newest = states.groupBy(*k).agg(F.max_by(F.struct(*columns), "run_id").alias("s")).select(*k, "s.*")
    return Fitted(newest, nodes)


def forecast_stored(spark: SparkSession, path: str, keys: Sequence[str], horizon: int | None = None, run_id: str | None = None) -> DataFrame:
    """The forecast of every segment from its latest stored model, over the stored horizon or `horizon` steps."""
    fitted = latest(spark, path, keys, run_id)
    if horizon is not None:
        fitted = Fitted(fitted.states.withColumn("h", F.lit(horizon)), fitted.nodes)
    return forecast_states(fitted, keys)
