"""Odd inputs: date layouts, workbooks with real dates, NaN, dots in headers; plans of the rollups."""

import zipfile
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import numpy_arima as NA
from conftest import SF_SMALL
from ledgerlens.functions.dates import to_day
from ledgerlens.operators import clean as C
from ledgerlens.operators import rollups as RU
from ledgerlens.operators.forecast import arima as AR
from ledgerlens.operators.forecast import compare as CM
from ledgerlens.operators.forecast import trees as TR
from ledgerlens.sources import files as FS
from ledgerlens.sources import tables as TB

D = date(2024, 1, 15)
LAYOUTS = {
    "2024-01-15": D, "2024/1/15": D, "2024.01.15": D, "20240115": D, "15-Jan-2024": D, "15 January 2024": D, "Jan 15, 2024": D,
    "January 15 2024": D, "Monday, January 15, 2024": D, "1/15/2024": D, "15/01/2024": D, "15.1.2024": D, "01-15-2024": D,
    "2024-01-15 10:00": D, "2024-01-15 10:00:59": D, "2024-01-15T23:59:59Z": D, "2024-01-15T23:59:59.123456+05:30": D,
    "2024-01-15 11:30 PM": D, "1/15/2024 9:05 am": D, "15th Jan 2024": D, "2024-Jan-15": D, " 2024-01-15 ": D,
    "2024-01": date(2024, 1, 1), "Jan 2024": date(2024, 1, 1), "Jan-2024": date(2024, 1, 1), "2024": date(2024, 1, 1),
    "1/5/2024": date(2024, 1, 5), "2024-02-29": date(2024, 2, 29),
    "9999-01-01": None, "1500-01-01": None, "2023-02-29": None, "2024-13-01": None, "32/01/2024": None, "13/13/2024": None, "soon": None, "": None, "12": None,
    "2024-01-15 nonsense": None, "Mayhem 2024x": None,
}


def test_date_layouts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*LAYOUTS, None])], "i int, t string")
    got = {r.t: r.d for r in df.select("t", to_day(F.col("t"), T.StringType()).alias("d")).collect()}
    assert got == {**LAYOUTS, None: None}


def test_month_column_cleans(spark):
    df = spark.createDataFrame([("2024-01", 5.0), ("2024-02", float("nan")), (None, 1.0)], "Month string, sales double")
    out, _ = C.clean_sales(df)
    assert sorted((r.Date, r.Revenue) for r in out.collect()) == [(date(2024, 1, 1), 5.0), (date(2024, 2, 1), 0.0)]


def workbook(path, rows, styles=""):
    """Cells: text, numbers, or (number, style)."""
    body = ""
    for r, row in enumerate(rows, 1):
        cells = ""
        for c, v in enumerate(row):
            ref = f'r="{chr(65 + c)}{r}"'
            if isinstance(v, str):
                cells += f'<c {ref} t="inlineStr"><is><t>{v}</t></is></c>'
            elif isinstance(v, tuple):
                cells += f'<c {ref} s="{v[1]}"><v>{v[0]}</v></c>'
            elif v is not None:
                cells += f"<c {ref}><v>{v}</v></c>"
        body += f'<row r="{r}">{cells}</row>'
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets/></workbook>")
        z.writestr("xl/styles.xml", f"<styleSheet {ns}>{styles}</styleSheet>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


STYLES = ('<numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy"/><numFmt numFmtId="165" formatCode="0.00 &quot;days&quot;"/>'
          '</numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs>')


def test_workbooks_with_dates_and_other_column_orders(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [["Date", "Product", "Sales"], [(45306, 1), "A", 10], [(45307.5, 2), "B", (2.5, 3)]], STYLES)
    workbook(tmp_path / "b.xlsx", [["Sales", "Date", "Product", "Region"], [99, (45308, 1), "C", "North"]], STYLES)
    df = FS.read_upload(spark, str(tmp_path) + "/*.xlsx", "xlsx")
    assert df.columns == ["Date", "Product", "Sales", "Region"]
    clean, _ = C.clean_sales(df)
    assert sorted((r.Date, r.Product, r.Revenue, r.Region) for r in clean.collect()) == [
        (date(2024, 1, 15), "A", 10.0, "Unknown"), (date(2024, 1, 16), "B", 2.5, "Unknown"), (date(2024, 1, 17), "C", 99.0, "North")]


def test_manifest_keeps_files_of_one_name_apart(spark, tmp_path):
    for d, n in (("x", 2), ("y", 3)):
        (tmp_path / d).mkdir()
        (tmp_path / d / "f.csv").write_text("a,b\n" + "1,2\n" * n)
    man = FS.ingest_manifest(FS.read_upload(spark, str(tmp_path) + "/*/f.csv", "csv")).collect()
    assert sorted(r.rows for r in man) == [2, 3] and len({r.path for r in man}) == 2


def test_empty_guards_axis_columns_and_typed_empty_table(spark):
    from ledgerlens.operators.schema_map import axis_columns
    empty = C.empty_cleaned(spark)
    assert empty.schema == C.CLEANED_SCHEMA and empty.count() == 0
    with pytest.raises(ValueError, match="No usable rows"):
        C.require_rows(empty)
    assert axis_columns(empty) == ["Date", "Product", "Region", "Month", "Quarter", "Day"]


def test_token_lookup(spark):
    from ledgerlens.operators import users as US
    s, u = TB.sessions(spark, SF_SMALL), TB.users(spark, SF_SMALL)
    some = US.active_sessions(s, u, "2024-01-20 00:00:00").first()
    found = US.session_for_token(s, u, some.token, "2024-01-20 00:00:00").collect()
    assert [tuple(r) for r in found] == [tuple(some)]


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_product_region_scans_once_and_has_no_cartesian_product(spark):
    clean = C.clean_sales(TB.sales(spark, SF_SMALL))[0]
    df = RU.product_region(clean)
    df.collect()
    plan = executed(df)
    assert "CartesianProduct" not in plan and "ReusedExchange" in plan


def test_builders_run_no_job(spark):
    """Heatmap and filter fallback are lazy: building them starts no Spark job."""
    clean = C.clean_sales(TB.sales(spark, SF_SMALL))[0]
    sc = spark.sparkContext
    sc.setJobGroup("lazy", "lazy")
    RU.heatmap(clean)
    C.filter_or_all(clean, "Region", "nowhere")
    jobs = sc.statusTracker().getJobIdsForGroup("lazy")
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert not jobs


# ---------------------------------------------------------------- forecasts

def arima_request(spark, data, h):
    from ledgerlens.operators.forecast import base as B
    rows = [(str(s), i, float(v)) for s, ys in data.items() for i, v in enumerate(ys)]
    df = spark.createDataFrame(rows, "seg string, t int, y double")
    df = df.select("seg", F.date_add(F.lit("2024-01-01").cast("date"), F.col("t")).alias("ds"), "y")
    return B.with_length(df, ["seg"]).withColumn("h", F.lit(h))


def test_arima_choice_rests_on_many_days(spark):
    data = {n: 50 + np.cumsum(np.random.default_rng(n).normal(size=n)) for n in (15, 23, 28, 41, 100)}
    got = {int(r.seg): r for r in AR.best_fits(arima_request(spark, data, 3), ["seg"]).collect()}
    for n, y in data.items():
        sample = n - NA.longest_loss(n)
        assert sample >= n - 16 and sample >= 10
        fits = {}
        for i, order, seasonal in AR.CANDIDATES:
            if (order, seasonal) in NA.candidates(n):
                try:
                    fits[i] = NA.fit_forecast(y, order, seasonal, 3)[2]
                except ValueError:
                    pass
        best = got[n]
        assert best.aic == pytest.approx(min(fits.values())) and fits[best.cid] == pytest.approx(best.aic)
        assert np.isfinite(best.path).all() and np.min(best.deviation) >= 0


def test_arima_falls_back_when_no_candidate_fits(spark):
    data = {"a": [3.0], "b": [1.0, 2.0]}
    got = AR.best_fits(arima_request(spark, data, 4), ["seg"]).collect()
    assert len(got) == 2
    for r in got:
        assert r.cid == AR.FALLBACK_CID and len(r.path) == 4 and np.isfinite(r.path).all() and np.isfinite(r.deviation).all()
        assert any(AR.MSG_TOO_FEW in e for e in r.errors)


def series(spark, lengths):
    rng = np.random.default_rng(4)
    rows = [(s, i, float(100 + 10 * (i % 7) + rng.normal())) for s, n in lengths.items() for i in range(n)]
    df = spark.createDataFrame(rows, "seg string, t int, y double")
    return df.select("seg", F.date_add(F.lit("2024-01-01").cast("date"), F.col("t")).alias("ds"), "y")


def request(spark, lengths, h=3):
    from pyspark.sql import Window
    w = Window.partitionBy("seg")
    s = series(spark, lengths)
    return (s.withColumn("n", F.count(F.lit(1)).over(w).cast("int")).withColumn("t", F.row_number().over(w.orderBy("ds")) - 1)
            .withColumn("h", F.lit(h)))


def test_tree_lags_per_segment(spark):
    small = {"num_trees": 5, "max_depth": 3}
    both = TR.forest_forecast(request(spark, {"a": 100, "b": 26}), ["seg"], **small).collect()
    assert {(r.seg, r.extra) for r in both} == {("a", "lags=21"), ("b", "lags=8")} and len(both) == 6
    alone = TR.forest_forecast(request(spark, {"a": 100}), ["seg"], **small).collect()
    assert [r.forecast for r in both if r.seg == "a"] == pytest.approx([r.forecast for r in alone])
    given = spark.createDataFrame([("a", 9), ("b", 7)], "seg string, lags int")
    fixed = TR.boosting_forecast(request(spark, {"a": 100, "b": 26}), ["seg"], n_lags=given, max_iter=5).collect()
    assert {(r.seg, r.extra) for r in fixed} == {("a", "lags=9"), ("b", "lags=7")}


def test_comparison_keeps_segments_with_nan_days_and_lags_of_the_backtest(spark):
    s = series(spark, {"a": 60, "b": 60}).withColumn("y", F.when(
        (F.col("seg") == "b") & (F.col("ds") == "2024-02-29"), float("nan")).otherwise(F.col("y")))
    params = {"forest": {"num_trees": 5, "max_depth": 3}}
    r = CM.compare_forecasting_models(s, ["seg"], 7, models=("forest",), tree_params=params)
    comparison = {x.seg: x.extra for x in r.comparison.collect()}
    assert set(comparison) == {"a", "b"}
    rows = r.forecast.collect()
    assert {x.seg for x in rows} == {"a", "b"} and all(np.isfinite(x.forecast) for x in rows)
    only = CM.compare_forecasting_models(s, ["seg"], 7, models=("forest",), tree_params=params, refit=False)
    assert only.forecast is None and {x.seg: x.extra for x in only.comparison.collect()} == comparison


def test_a_segment_that_fails_loses_one_model_for_itself(spark):
    """Values whose squares overflow: least squares fails, the trees work on scaled values."""
    s = series(spark, {"a": 60, "big": 60, "odd": 60})
    s = s.withColumn("y", F.when(F.col("seg") == "big", F.col("y") * 1e160).otherwise(F.col("y")))
    s = s.withColumn("y", F.when((F.col("seg") == "odd") & (F.col("ds") == "2024-02-01"), float("inf")).otherwise(F.col("y")))
    params = {"forest": {"num_trees": 5, "max_depth": 3}}
    r = CM.compare_forecasting_models(s, ["seg"], 7, models=("sarimax", "forest"), tree_params=params)
    alone = CM.compare_forecasting_models(s.where("seg = 'a'"), ["seg"], 7, models=("sarimax",), tree_params=params, refit=False)
    rows = {(x.seg, x.model): x for x in r.comparison.collect()}
    assert set(rows) == {("a", "SARIMAX"), ("a", "Random Forest"), ("big", "Random Forest")}
    assert rows["a", "SARIMAX"].mape == pytest.approx(alone.comparison.first().mape)
    failed = {(x.seg, x.model): x.error for x in r.failures.collect()}
    assert set(failed) == {("big", "SARIMAX"), ("odd", "SARIMAX"), ("odd", "Random Forest")}
    assert failed["odd", "SARIMAX"] == CM.ERR_VALUES and failed["big", "SARIMAX"] == CM.ERR_NO_FIT
    best = {x.seg: (x.best_model, x.message) for x in r.summary.collect()}
    assert best["big"][0] == "Random Forest" and best["odd"] == ("Moving Average", CM.MSG_ALL_FAILED)
    assert alone.failures.count() == 0


def test_a_job_that_fails_is_raised(spark):
    from pyspark.errors import IllegalArgumentException
    params = {"forest": {"max_depth": 99}}  # Spark refuses more than 30
    with pytest.raises(IllegalArgumentException, match="maxDepth"):
        CM.compare_forecasting_models(series(spark, {"a": 60}), ["seg"], 7, models=("forest", "ets"), tree_params=params)


def test_saved_winner_predicts_again(spark, tmp_path):
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.regression import RandomForestRegressionModel
    params = {"forest": {"num_trees": 5, "max_depth": 3}}
    r = CM.compare_forecasting_models(series(spark, {"a": 130}), ["seg"], 7, models=("forest",), tree_params=params,
                                      save_to=str(tmp_path))
    saved = spark.read.parquet(str(tmp_path / "bundle")).first()
    first = r.forecast.where("step = 1").first()
    assert saved.best_model == "Random Forest" and saved.config == "lags=21" and len(saved.history_tail) == 120
    assert saved.horizon == 7 and saved.residual_std >= 0 and len(saved.feature_columns) == 28
    values = [x.y for x in series(spark, {"a": 130}).orderBy("ds").collect()]
    assert saved.history_tail == pytest.approx(values[-120:])
    scale, h = np.mean(values), np.asarray(saved.history_tail) / np.mean(values)
    row = [*h[::-1][:21], h[-7:].mean(), h[-14:].mean(), h[-7:].std(), h[-14:].std(),
           first.ds.weekday(), first.ds.month, first.ds.day]
    model = RandomForestRegressionModel.load(saved.model_path)
    assert model.predict(Vectors.dense(row)) * scale == pytest.approx(first.forecast)
