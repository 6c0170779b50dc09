"""Mergeable KPI states against plain numpy and pandas."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import kpi as K
from ledgerlens.operators import kpi_state as ST

D0 = dt.date(2023, 11, 1)


def _sales(spark, n=4000, level=0.0, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(D0 + dt.timedelta(days=int(rng.integers(0, 120))), float(level + rng.uniform(0, 100)), f"p{rng.integers(0, 7)}",
             f"r{rng.integers(0, 3)}", 1.0) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "Date date, Revenue double, Product string, Region string, Quantity double")


@pytest.mark.parametrize("level", [0.0, 1e6])
def test_merged_deviation_equals_numpy(spark, level):
    """Also where values are large and close together, so that sums of squares would cancel."""
    rows, df = _sales(spark, level=level)
    for keys in (["Region"], ["Product"], ["Product", "Region"]):
        got = {tuple(r[k] for k in keys): r for r in ST.merge_states(ST.daily_states(df), keys).collect()}
        at = [{"Product": 2, "Region": 3}[k] for k in keys]
        for key, r in got.items():
            values = np.asarray([x[1] for x in rows if tuple(x[i] for i in at) == key])
            assert r.n == len(values) and r.mean == pytest.approx(values.mean(), rel=1e-12)
            assert r.m2 == pytest.approx(((values - values.mean()) ** 2).sum(), rel=1e-8)


def test_merging_in_steps_and_batches(spark):
    _, df = _sales(spark)
    whole = ST.merge_states(ST.daily_states(df), ["Region"]).orderBy("Region").collect()
    halves = ST.daily_states(df.where("Revenue < 50")).unionByName(ST.daily_states(df.where("Revenue >= 50")))
    steps = ST.merge_states(ST.merge_states(halves, ["Region", "Product"]), ["Region"]).orderBy("Region").collect()
    for a, b in zip(whole, steps, strict=True):
        assert (a.rows, a.n, a.first_ds, a.last_ds) == (b.rows, b.n, b.first_ds, b.last_ds)
        assert a.total == pytest.approx(b.total) and a.m2 == pytest.approx(b.m2, rel=1e-10)


def test_null_revenue_and_single_rows(spark):
    df = spark.createDataFrame([(D0, None, "a", "x"), (D0, 5.0, "a", "x"), (D0, None, "b", "x")],
                               "Date date, Revenue double, Product string, Region string")
    got = {r.Product: r for r in ST.merge_states(ST.daily_states(df), ["Product"]).withColumn("std", ST.std_samp(F.col("n"), F.col("m2"))).collect()}
    assert (got["a"].rows, got["a"].n, got["a"].mean, got["a"].m2, got["a"].std) == (2, 1, 5.0, 0.0, None)
    assert (got["b"].rows, got["b"].n, got["b"].total, got["b"].std) == (1, 0, None, None)


def test_date_range_reads_only_its_files(spark, tmp_path):
    _, df = _sales(spark)
    path = str(tmp_path / "states")
    ST.write_states(ST.daily_states(df), path)
    ranged = ST.read_states(spark, path, "2024-01-05", "2024-02-01")
    plan = ranged._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "state_year" in plan.split("PartitionFilters")[1] and "GreaterThanOrEqual(Date" in plan
    assert "state_year=2023" not in " ".join(ranged.inputFiles()) or "2024" in plan
    want = K.calculate_kpis(df.where("Date BETWEEN '2024-01-05' AND '2024-02-01'"), ["Region"]).orderBy("Region").collect()
    got = K.kpis_from_states(ranged, ["Region"]).orderBy("Region").collect()
    for a, b in zip(want, got, strict=True):
        for c in a.asDict():
            assert a[c] == (pytest.approx(b[c], rel=1e-10) if isinstance(a[c], float) else b[c])


def test_raw_rows_pass_one_aggregate_without_expand(spark):
    _, df = _sales(spark)
    plan = ST.daily_states(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Expand" not in plan
    record = K.calculate_kpis(df, ["Region"])._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" not in record and "LogicalRDD" not in record  # the states alone
    after = record[record.index("Expand"):].splitlines()[1]  # the levels expand merged cells, not states
    assert "Aggregate" in after
    assert not spark.sparkContext._jsc.getPersistentRDDs().size()


def test_null_segment_keys_stay(spark):
    df = spark.createDataFrame([(D0, 1.0, "a", None), (D0, 3.0, "b", None), (D0, 2.0, "a", "x")],
                               "Date date, Revenue double, Product string, Region string")
    got = {r.Region: r.total_revenue for r in K.calculate_kpis(df, ["Region"]).collect()}
    assert got == {None: 4.0, "x": 2.0}
