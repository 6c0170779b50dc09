"""Random-forest and gradient-boosting forecasts with recursive multi-step prediction.

One pooled Spark ML model is trained over all segments with the same lag count (targets
scaled by the segment's training mean, so series of different size share trees). The fitted ensemble
is read back as arrays of nodes, one row a model. A forecast is one projection: a fold over the steps
builds the next feature row from the segment's history array, walks every tree through the node
arrays, and appends the floored prediction, so all steps of all segments are one job and need the
stored state alone.

A segment that cannot be trained on (values that are not finite, no complete lag window) takes no part
in the pooled model and gets no state.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...plans.joins import drop_seg, seg_keys
from ...session import ensure_checkpoint_dir
from .. import series as S
from .arrays import computed, let, total
from .base import BOOSTING, FOREST, band, fit_partitions

# Model sizes and seeds from the reference; lag rule min(21, max(7, n // 3)).
FOREST_TREES = 400
BOOSTING_ROUNDS = 300
BOOSTING_RATE = 0.05
BOOSTING_DEPTH = 3
SEED = 42
MAX_LAGS, MIN_LAGS, LAG_DIVISOR = 21, 7, 3
ROLL_WINDOWS = (7, 14)
# Own choice, a public argument (`max_depth`): Spark bounds the depth by 30 and the reference
# grows forest trees fully; deeper trees cost time and memory (see README, Deviations).
FOREST_DEPTH = 8
# Candidate splits a feature, a public argument (`max_bins`); the reference tries every threshold.
BINS = 32
# Memory for split statistics per pass: larger means fewer passes over the training rows.
NODE_MEMORY_MB = 1024
# Least training rows of a partition, up to one partition a core. A forest takes few, heavy
# passes over its rows; boosting takes thousands of light ones, where every task costs more than
# it computes until partitions are larger.
LEAST_ROWS = {"forest": 500, "boosting": 20_000}
# Boosting keeps per-row predictions across rounds; checkpoint them every N rounds so a lost
# executor recomputes at most N rounds (and the lineage stays shallow).
GBT_CHECKPOINT_INTERVAL = 25


def lag_count(n_train: Column | int) -> Column:
    """min(21, max(7, n // 3))."""
    n = F.lit(n_train) if isinstance(n_train, int) else n_train
    return F.least(F.lit(MAX_LAGS), F.greatest(F.lit(MIN_LAGS), F.floor(n / LAG_DIVISOR).cast("int")))


def feature_columns(n_lags: int) -> list[str]:
    return ([f"lag_{k}" for k in range(1, n_lags + 1)]
            + [f"roll_mean_{w}" for w in ROLL_WINDOWS] + [f"roll_std_{w}" for w in ROLL_WINDOWS]
            + ["dayofweek", "month", "day"])


def _estimator(kind: str, params: dict):
    if kind == "forest":
        return RandomForestRegressor(featuresCol="features", labelCol="label",
                                     numTrees=params.get("num_trees", FOREST_TREES),
                                     maxDepth=params.get("max_depth", FOREST_DEPTH),
                                     maxBins=params.get("max_bins", BINS),
                                     featureSubsetStrategy="all",
                                     maxMemoryInMB=NODE_MEMORY_MB, seed=SEED)
    return GBTRegressor(featuresCol="features", labelCol="label",
                        maxIter=params.get("max_iter", BOOSTING_ROUNDS),
                        stepSize=params.get("step_size", BOOSTING_RATE),
                        maxDepth=params.get("max_depth", BOOSTING_DEPTH), maxBins=params.get("max_bins", BINS),
                        maxMemoryInMB=NODE_MEMORY_MB, checkpointInterval=GBT_CHECKPOINT_INTERVAL, seed=SEED)


def tree_forecast(request: DataFrame, keys: Sequence[str] = (), kind: str = "forest",
                  n_lags: int | DataFrame | None = None, save_to: str | None = None, **params) -> DataFrame:
    """Forecast h steps per segment with tree models (`kind` = forest | boosting).

    Returns the standard forecast rows plus `extra`; see `fit_trees`."""
    user_keys = list(keys)
    request, k = seg_keys(request, user_keys)
    if isinstance(n_lags, DataFrame):
        n_lags, _ = seg_keys(n_lags, user_keys)
    states, nodes = fit_trees(request, k, kind, n_lags, save_to, **params)
    return drop_seg(forecast_trees(states, nodes, k))


def fit_trees(request: DataFrame, keys: Sequence[str], kind: str, n_lags: int | DataFrame | None = None,
              save_to: str | None = None, **params) -> tuple[DataFrame, DataFrame]:
    """(states, nodes). States, one row a segment: h, last_ds, kind, lags, scale, sigma, hist and model_id; nodes, one
    row a model: model_id and its trees as arrays.

    Each segment takes the lag count of its own length (M12), or `n_lags`: one number, or
    (keys…, lags). Segments with equal lag counts (15 values at most) share one pooled
    model, which is saved under `save_to` (`model_path`), or under the checkpoint folder."""
    k = list(keys)
    spark = request.sparkSession
    shared = ensure_checkpoint_dir(spark)
    folder = save_to or f"{shared.rstrip('/')}/trees-{uuid.uuid4().hex}"
    if isinstance(n_lags, DataFrame):
        request = request.join(n_lags.select(*k, "lags"), k)
    else:
        request = request.withColumn("lags", F.lit(int(n_lags)) if n_lags is not None else lag_count(F.col("n")))
    # the learner passes over its input several times: written (a row a day), in as few partitions as its bytes need
    request = request.checkpoint()
    counts = sorted(r.lags for r in request.select("lags").distinct().collect())
    parts = [_pooled(request.where(F.col("lags") == n), k, kind, n, params, folder) for n in counts]
    parts = [p for p in parts if p is not None]
    if not parts:
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in (request.schema[c] for c in k)]
        return (spark.createDataFrame([], ", ".join([*fields, STATE])), spark.createDataFrame([], NODES))
    states, nodes = parts[0]
    for more_states, more_nodes in parts[1:]:
        states, nodes = states.unionByName(more_states), nodes.unionByName(more_nodes)
    return states, nodes


def model_path(folder: str, kind: str, lags: int) -> str:
    return f"{folder.rstrip('/')}/{kind}-lags-{lags}"


STATE = ("h int, last_ds date, kind string, lags int, scale double, sigma double, hist array<double>, model_id string")
NODES = ("model_id string, depth int, roots array<int>, feature array<int>, threshold array<double>, left array<int>, "
         "right array<int>, value array<double>")


def _pooled(request: DataFrame, k: list[str], kind: str, lags: int, params: dict, folder: str) -> tuple[DataFrame, DataFrame] | None:
    """The states and the node row of one pooled model for the segments of `request`; None if none can be trained on."""
    spark = request.sparkSession
    need = lags + max(ROLL_WINDOWS)
    recent = F.when(F.col("t") >= F.col("n") - need, F.struct("t", "y"))
    seg = (request.groupBy(*k)
           .agg(F.avg("y").alias("__mu"), F.first("n").alias("n"), F.first("h").alias("h"),
                F.max("ds").alias("last_ds"), F.min_by("y", "t").alias("__first"), F.every(F.abs("y") < float("inf")).alias("__finite"),
                F.transform(F.sort_array(F.collect_list(recent)), lambda p: p["y"]).alias("tail"))
           .where("__finite").withColumn("scale", F.when(F.col("__mu") > 0, F.col("__mu")).otherwise(F.lit(1.0)))).checkpoint()
    cols = feature_columns(lags)

    scaled = request.join(seg.select(*k, "scale"), k).withColumn("y", F.col("y") / F.col("scale"))
    feats = S.supervised_features(scaled.select(*k, "ds", "y"), k, lags)
    assembler = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep")
    train = assembler.transform(feats).select(*k, "ds", "features", F.col("y").alias("label"))
    # iterative learners run several jobs per round: size partitions to the rows, not to
    # the shuffle setting, so small pooled sets do not pay for hundreds of empty tasks
    rows = train.count()
    if not rows:
        return None
    cores = spark.sparkContext.defaultParallelism
    # dealt and sorted by key and day: the forest draws by partition and place, so reruns agree however the rows came
    train = (train.repartition(max(1, min(cores, rows // LEAST_ROWS[kind])), *k, "ds").sortWithinPartitions(*k, "ds")
             .persist(StorageLevel.MEMORY_AND_DISK))
    model = _estimator(kind, params).fit(train)
    path = model_path(folder, kind, lags)
    model.write().overwrite().save(path)

    # in-sample residual σ per segment, back on the original scale (population std); a segment
    # without a training row has none, and takes no forecast from the others' model
    resid = (model.transform(train).groupBy(*k)
             .agg(F.coalesce(F.stddev_pop(F.col("label") - F.col("prediction")), F.lit(0.0)).alias("sigma"))).checkpoint()
    train.unpersist()

    # history: the last lags+14 scaled values, left-padded with the series' first value
    hist = F.transform(F.concat(F.array_repeat(F.col("__first"), F.greatest(F.lit(0), need - F.size("tail"))), F.col("tail")),
                       lambda y: y / F.col("scale"))
    states = seg.join(resid, k).select(
        *k, F.col("h").cast("int").alias("h"), "last_ds", F.lit(kind).alias("kind"), F.lit(lags).alias("lags"), "scale",
        (F.col("sigma") * F.col("scale")).alias("sigma"), hist.alias("hist"), F.lit(path).alias("model_id"))
    return states, node_arrays(spark, path).checkpoint()


def node_arrays(spark, path: str) -> DataFrame:
    """The trees of a saved ensemble in one row of arrays, bounded by the model's size: `roots` are where trees begin,
    `left` is -1 at a leaf, and a prediction is the sum of the leaves' `value`s (tree weights included)."""
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    weights = spark.read.parquet(f"{path}/treesMetadata")
    weights = weights.select(F.col(weights.columns[0]).alias("treeID"), F.col(weights.columns[2]).alias("weight"))
    about = spark.read.json(f"{path}/metadata").select("class", F.col("paramMap.maxDepth").alias("depth")).first()
    share = 1.0 if about["class"].endswith("GBTRegressionModel") else 1.0 / weights.count()
    node = F.struct("treeID", "id", F.col("split.featureIndex").alias("feature"),
                    F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), F.col("leftChild").alias("left"),
                    F.col("rightChild").alias("right"), (F.col("prediction") * F.col("weight")).alias("value"))
    per_tree = weights.withColumn("weight", F.col("weight") * share)  # one row a tree
    flat = (nodes.join(per_tree, "treeID").groupBy().agg(F.sort_array(F.collect_list(node)).alias("nodes"))
            .withColumn("begin", F.filter(F.transform("nodes", lambda x, i: F.when(x["id"] == 0, i)), lambda i: i.isNotNull())))

    def child(name):
        return F.transform("nodes", lambda x: F.when(x[name] < 0, F.lit(-1)).otherwise(F.get("begin", x["treeID"]) + x[name]))
    return flat.select(F.lit(path).alias("model_id"), F.lit(int(about["depth"])).alias("depth"), F.col("begin").alias("roots"),
                       F.transform("nodes", lambda x: x["feature"]).alias("feature"),
                       F.transform("nodes", lambda x: F.coalesce(x["threshold"], F.lit(0.0))).alias("threshold"),
                       child("left").alias("left"), child("right").alias("right"),
                       F.transform("nodes", lambda x: x["value"]).alias("value"))


def _ensemble(x: Column) -> Column:
    """The prediction for a feature array, by walking every tree of the row's node arrays."""
    def walked(root):
        return F.aggregate(F.sequence(F.lit(1), F.col("depth")), root, lambda node, _: F.when(F.get("left", node) < 0, node)
                           .when(F.get(x, F.get("feature", node)) <= F.get("threshold", node), F.get("left", node))
                           .otherwise(F.get("right", node)))
    return F.aggregate("roots", F.lit(0.0), lambda s, root: s + F.get("value", walked(root)))


def _features(hist: Column, day: Column) -> Column:
    """The feature row after `hist`, in the order of `feature_columns`; at prediction the reference takes the
    population std, in training the sample std."""
    def windowed(of):
        return [let(F.slice(hist, -w, w), of) for w in ROLL_WINDOWS]

    def mean(v):
        return total(v) / F.size(v)

    def deviation(v):
        return let(mean(v), lambda m: F.sqrt(mean(F.transform(v, lambda u: (u - m) * (u - m)))))
    return F.concat(F.reverse(F.slice(hist, -F.col("lags"), F.col("lags"))), F.array(
        *windowed(mean), *windowed(deviation), *[f(day).cast("double") for f in (F.weekday, F.month, F.dayofmonth)]))


def forecast_trees(states: DataFrame, nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The forecast rows of fitted states: one fold over the steps of each segment."""
    k = list(keys)
    begin = F.struct(F.col("hist").alias("hist"), F.array().cast("array<double>").alias("path"))

    def step(acc, i):
        x = _features(acc["hist"], F.date_add("last_ds", i))
        return let(F.greatest(let(x, _ensemble), F.lit(0.0)), lambda v: F.struct(
            F.concat(F.slice(acc["hist"], 2, F.size(acc["hist"]) - 1), F.array(v)).alias("hist"),
            F.concat(acc["path"], F.array(v)).alias("path")))
    parts = fit_partitions(states.sparkSession)
    # a row a pooled model (30 at most), each bounded by the number and depth of its trees
    rows = states.repartition(parts, *k).join(F.broadcast(nodes), "model_id")
    paths = computed(rows, [*k, "last_ds", "kind", "lags", "scale", "sigma"],
                     path=F.aggregate(F.sequence(F.lit(1), F.col("h")), begin, step, lambda acc: acc["path"]))
    out = paths.select(*k, "last_ds", "kind", "lags", "scale", "sigma", F.posexplode("path").alias("pos", "p"))
    fc = F.col("p") * F.col("scale")
    lo, hi = band(fc, F.col("sigma"))
    return out.select(*k, F.when(F.col("kind") == "forest", FOREST).otherwise(BOOSTING).alias("model"), (F.col("pos") + 1).alias("step"),
                      F.date_add("last_ds", F.col("pos") + 1).alias("ds"), fc.alias("forecast"),
                      lo.alias("lower"), hi.alias("upper"), F.concat(F.lit("lags="), F.col("lags").cast("string")).alias("extra"))


def forest_forecast(request: DataFrame, keys: Sequence[str] = (), **params) -> DataFrame:
    """M10."""
    return tree_forecast(request, keys, "forest", **params)


def boosting_forecast(request: DataFrame, keys: Sequence[str] = (), **params) -> DataFrame:
    """M11."""
    return tree_forecast(request, keys, "boosting", **params)
