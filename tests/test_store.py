"""Stored models, stored sessions and users, the ledger of files, and the row index on equal keys."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import report as RP
from ledgerlens.operators import series as S
from ledgerlens.operators import users as U
from ledgerlens.operators.forecast import base as B
from ledgerlens.operators.forecast import compare as CM
from ledgerlens.operators.forecast import ets as ET
from ledgerlens.operators.forecast import store as ST
from ledgerlens.operators.forecast import trees as TR
from ledgerlens.plans.ordering import with_row_index
from ledgerlens.sources import files as FS

D0 = dt.date(2024, 1, 1)


def series(spark, data):
    rows = [(s, D0 + dt.timedelta(days=i), float(v)) for s, ys in data.items() for i, v in enumerate(ys)]
    return spark.createDataFrame(rows, "seg string, ds date, y double")


def example(seed=0, n=100):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return {"a": 100 + 10 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 1, n), "b": np.abs(50 + np.cumsum(rng.normal(0, 2, n)))}


def request(spark, data, h=6):
    return B.with_length(series(spark, data), ["seg"]).withColumn("h", F.lit(h))


def values(df, *keys):
    return {tuple(r[k] for k in keys): (r.forecast, r.lower, r.upper) for r in df.collect()}


SMALL = {"forest": {"num_trees": 7, "max_depth": 4}, "boosting": {"max_iter": 9}}


def test_every_model_forecasts_from_the_store(spark, tmp_path):
    """What is read back forecasts the same, for all models at once, without the series."""
    req, path = request(spark, example()), str(tmp_path / "store")
    fits = [ST.fit(m, req, ["seg"], **SMALL.get(m, {})) for m in ("sarimax", "ets", "forest", "boosting", "average")]
    both = ST.together(fits)
    run = ST.save(both, path)
    stored = ST.Fitted(spark.read.parquet(f"{path}/states"), spark.read.parquet(f"{path}/nodes").drop("run_id"))
    direct = values(ST.forecast_states(both, ["seg"]), "seg", "model", "step")
    again = values(ST.forecast_states(stored, ["seg"]), "seg", "model", "step")
    assert len(direct) == 2 * 5 * 6 and set(direct) == set(again)
    for key, v in direct.items():
        assert again[key] == pytest.approx(v, rel=1e-9), key
    assert spark.read.parquet(f"{path}/states").select("run_id").distinct().count() == 1 and run


def test_latest_run_of_each_segment_wins(spark, tmp_path):
    path, data = str(tmp_path / "store"), example()
    first = ST.save(ST.fit("average", request(spark, data), ["seg"]), path)
    ST.save(ST.fit("ets", request(spark, {"a": data["a"]}), ["seg"]), path)
    got = {r.seg: r.model for r in ST.forecast_stored(spark, path, ["seg"]).select("seg", "model").distinct().collect()}
    assert got == {"a": "Exponential Smoothing", "b": "Moving Average"}
    old = ST.forecast_stored(spark, path, ["seg"], run_id=first).select("model").distinct().collect()
    assert [r.model for r in old] == ["Moving Average"]
    assert ST.forecast_stored(spark, path, ["seg"], horizon=3).groupBy("seg").count().where("count = 3").count() == 2


def test_comparison_writes_a_run_that_repeats_its_forecast(spark, tmp_path):
    path = str(tmp_path / "models")
    s = series(spark, {**example(), "short": [5.0, 6.0] * 6})
    for _ in range(2):
        r = CM.compare_forecasting_models(s, ["seg"], 7, models=("sarimax", "ets", "forest"), tree_params=SMALL, save_to=path)
    stored = ST.forecast_stored(spark, path, ["seg"])
    direct, again = values(r.forecast, "seg", "step"), values(stored, "seg", "step")
    assert set(direct) == set(again) and len({k[0] for k in again}) == 3
    for key, v in direct.items():
        assert again[key] == pytest.approx(v, rel=1e-9)
    assert spark.read.parquet(f"{path}/bundle").select("run_id").distinct().count() == 2
    best = {r.seg: r.best_model for r in r.summary.collect()}
    assert {r.seg: r.model for r in stored.select("seg", "model").distinct().collect()} == best


@pytest.mark.parametrize("kind", ["forest", "boosting"])
def test_one_fold_equals_step_by_step_prediction(spark, kind):
    """The recursion by the library's model, one driver round a step, against the fold over node arrays."""
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
    states, nodes = TR.fit_trees(request(spark, example(3)), ["seg"], kind, **SMALL[kind])
    got = values(TR.forecast_trees(states, nodes, ["seg"]), "seg", "step")
    for s in states.collect():
        model = (RandomForestRegressionModel if kind == "forest" else GBTRegressionModel).load(s.model_id)
        hist = list(s.hist)
        for step in range(1, s.h + 1):
            day, h = s.last_ds + dt.timedelta(days=step), np.asarray(hist)
            x = [*h[::-1][:s.lags], h[-7:].mean(), h[-14:].mean(), h[-7:].std(), h[-14:].std(), day.weekday(), day.month, day.day]
            p = max(0.0, model.predict(Vectors.dense(x)))
            assert got[s.seg, step][0] == pytest.approx(p * s.scale, rel=1e-9)
            hist = hist[1:] + [p]
    plan = TR.forecast_trees(states, nodes, ["seg"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and plan.count("LogicalRDD") <= 3  # the states and the nodes, no step of its own


def test_ets_search_ends_in_an_optimum_or_says_so(spark, monkeypatch):
    data = example(5, 150)
    found = ET.optimality(request(spark, data), ["seg"]).collect()
    for r in found:
        assert r.converged and r.sse <= r.grid_sse and r.least_nearby >= r.sse * (1 - 1e-9) and r.passes < ET.MOST_PASSES
    monkeypatch.setattr(ET, "MOST_PASSES", 3)
    cut = ET.ets_state(request(spark, data), ["seg"], refine=True).collect()
    assert not any(r.converged for r in cut)
    extra = ST.fit("ets", request(spark, data), ["seg"]).states.select("extra").distinct().collect()
    assert [r.extra for r in extra] == ["seasonal=auto, not converged"]


def test_derivatives_equal_differences(spark):
    rng = np.random.default_rng(1)
    ys = 50 + rng.normal(0, 5, 40)
    p = [0.3, 0.2, 0.4, 48.0, 0.1, *rng.normal(0, 2, 7)]

    def lit(v):
        return F.array(*[F.lit(float(a)) for a in v])
    r = spark.range(1).select(ET._errors(lit(ys), lit(p)).alias("r")).first().r
    moved = [[v + d * (i == j) for j, v in enumerate(p)] for i in range(12) for d in (-1e-5, 1e-5)]
    sse = spark.range(1).select(F.array(*[ET._sse(lit(ys), lit(q)) for q in moved]).alias("x")).first().x
    slope = [(sse[2 * i + 1] - sse[2 * i]) / 2e-5 for i in range(12)]
    assert [2 * g for g in r.gradient] == pytest.approx(slope, rel=1e-4, abs=1e-3)


# ---------------------------------------------------------------- sessions and users

def sessions(spark, n=4000):
    return spark.range(n).select(
        F.col("id"), F.concat(F.lit("tok-"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("token"), (F.col("id") % 50).alias("user_id"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 5)").alias("created_at"),
        F.expr("timestamp'2024-01-08 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 5)").alias("expires_at"))


def listing(spark, path):
    return {r.path: (r.length, r.modified) for r in FS.listed_files(spark, path, ".parquet").collect()}


def test_purge_rewrites_one_day(spark, tmp_path):
    path, as_of = str(tmp_path / "sessions"), "2024-01-11 12:00:00"
    all_ = sessions(spark)
    U.store_sessions(all_, path)
    before = listing(spark, path)
    U.purge_stored(spark, path, as_of)
    after = listing(spark, path)
    kept = U.stored_sessions(spark, path).drop("expiry_day")
    want = U.purge_expired(all_, as_of)
    assert sorted(r.id for r in kept.collect()) == sorted(r.id for r in want.collect())
    days = {p.split("expiry_day=")[1][:10] for p in before if after.get(p) == before[p]}
    assert days == {p.split("expiry_day=")[1][:10] for p in before if p.split("expiry_day=")[1][:10] > "2024-01-11"}
    assert not [p for p in after if p.split("expiry_day=")[1][:10] < "2024-01-11"]
    U.purge_stored(spark, path, as_of)
    assert U.stored_sessions(spark, path).count() == want.count()
    U.purge_stored(spark, path, "2024-01-12 23:59:59.5")  # nothing of that day is left
    assert listing(spark, path).keys() == {p for p in after if p.split("expiry_day=")[1][:10] > "2024-01-12"}


def rows_read(spark, df):
    """Rows that the scan of `df` gave out."""
    df.collect()
    found = []

    def walk(node):
        if node.nodeName().startswith("Scan"):
            found.append(node.metrics().apply("numOutputRows").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))
    plan = df._jdf.queryExecution().executedPlan()
    walk(plan.executedPlan() if hasattr(plan, "executedPlan") and plan.nodeName() == "AdaptiveSparkPlan" else plan)
    return sum(found)


def test_lookups_skip_row_groups(spark, tmp_path):
    """Keys in random order: ranges do not help, Bloom filters of small row groups do."""
    folder = str(tmp_path / "random")
    keys = spark.range(0, 60_000, 1, 1).select(F.md5(F.col("id").cast("string")).alias("token"), "id").orderBy(F.xxhash64("id"))
    (keys.coalesce(1).write.option("parquet.bloom.filter.enabled#token", "true").option("parquet.bloom.filter.expected.ndv#token", "3000")
     .option("parquet.block.size", "65536").option("parquet.block.size.row.check.min", "1000").parquet(folder))
    one = spark.read.parquet(folder).where(F.col("token") == F.md5(F.lit("777")))
    assert one.first().id == 777 and rows_read(spark, one) < 30_000
    path, users = str(tmp_path / "users"), spark.range(9000).select("id", F.concat(F.lit(" User"), "id", F.lit("@Example.com ")).alias("email"), F.lit("viewer").alias("role"))
    U.store_users(users, path)
    stored = spark.read.parquet(path)
    assert U.user_for_email(stored, "user77@example.COM").first().id == 77 and U.user_for_email(stored, "none@x").count() == 0
    plan = U.user_for_email(stored, "a@b")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(email_key" in plan


# ---------------------------------------------------------------- files

def test_ledger_takes_each_file_once(spark, tmp_path):
    folder, book = tmp_path / "in", str(tmp_path / "ledger")
    folder.mkdir()
    (folder / "a.csv").write_text("x,y\n1,2\n3,4\n")
    (folder / "empty.csv").write_text("x,y\n")
    (folder / "note.txt").write_text("no upload")
    first = {r.filename: (r.rows, r.columns) for r in FS.take_files(spark, str(folder), book).collect()}
    assert first == {"a.csv": (2, ["x", "y"]), "empty.csv": (0, ["x", "y"])}
    assert FS.take_files(spark, str(folder), book).count() == 0 and FS.ledger(spark, book).count() == 2
    (folder / "b.csv").write_text("x,y\n5,6\n")
    assert [r.filename for r in FS.take_files(spark, str(folder), book).collect()] == ["b.csv"]
    assert FS.ledger(spark, book).agg(F.sum("rows")).first()[0] == 3


def test_comparison_in_the_document(spark):
    from ledgerlens.operators import clean as C
    raw = series(spark, example(n=60)).select(F.col("ds").alias("order_date"), F.col("y").alias("revenue"), F.col("seg").alias("region"))
    clean, roles = C.clean_sales(raw)
    r = CM.compare_forecasting_models(S.gap_fill(S.daily(clean, ["Region"]), ["Region"]).select("Region", "ds", "y"), ["Region"], 7,
                                      models=("sarimax", "ets"), refit=False)
    back = RP.comparison_from_document(RP.analysis_document(clean, roles, ["Region"], comparison=r.comparison), ["Region"])
    want = {(x.Region, x.model): (x.mape, x.extra) for x in r.comparison.collect()}
    got = {(x.Region, x.model): (x.mape, x.extra) for x in back.collect()}
    assert set(got) == set(want) and len(got) == 4
    for key, (mape, extra) in want.items():
        assert got[key][0] == pytest.approx(mape) and got[key][1] == extra


# ---------------------------------------------------------------- row index

def test_equal_keys_are_spread_over_ranges(spark):
    df = spark.range(0, 20_000, 1, 8).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(77)).alias("k"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the ranges are small here
    out = with_row_index(df, ["k"], "i")
    rows = out.withColumn("part", F.spark_partition_id()).collect()
    assert sorted(r.i for r in rows) == list(range(20_000)) and {r.row_total for r in rows} == {20_000}
    assert [r.k for r in sorted(rows, key=lambda r: r.i)] == sorted(r.k for r in rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    heavy = [r.part for r in rows if r.k == 77]
    assert max(heavy.count(p) for p in set(heavy)) < len(heavy) / 3
    again = {r.v: r.i for r in with_row_index(df.repartition(3), ["k"], "i").collect()}
    assert again == {r.v: r.i for r in rows}  # the same index for whatever partitions the rows come in


def test_row_index_with_nulls_equal_rows_and_none(spark):
    df = spark.createDataFrame([(None, {"a": 1}), (2, None), (2, None), (1, {"b": 2}), (None, {"a": 1})], "k int, m map<string, int>")
    out = with_row_index(df, ["k"], "i").orderBy("i").collect()
    assert [r.k for r in out] == [None, None, 1, 2, 2] and [r.i for r in out] == list(range(5))
    assert with_row_index(df.limit(0), ["k"]).collect() == []
