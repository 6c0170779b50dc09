"""The analysis document per segment (S10) and its flattening back to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import drop_seg, seg_keys
from ..plans.topk import group_top_k
from . import insights as I
from .kpi import KPI_FIELDS
from .schema_map import RoleMap

SAMPLE_ROWS = 10


def _collect_per_key(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Bounded per-segment lists (insights ≤ 7, forecast ≤ horizon, samples ≤ 10 rows)."""
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in cols if c != order])))
                                 .alias(name))


def analysis_document(clean: DataFrame, roles: RoleMap, keys: Sequence[str] = (),
                      forecast_summary: DataFrame | None = None,
                      forecast_rows: DataFrame | None = None, comparison: DataFrame | None = None) -> DataFrame:
    """One row per segment: schema roles, KPI struct, summary, insights, forecast, model comparison, sample
    rows, plus the whole record as JSON text (`document`).

    `comparison` has keys…, model, mae, rmse, mape and extra; the document lists it by MAPE, with the
    configuration where `extra` is known."""
    user_keys = list(keys)
    frame, k = seg_keys(I.analysis_frame(clean, user_keys, forecast_summary), user_keys)
    df, _ = seg_keys(clean, user_keys)
    # every per-segment part is a column of the one analysis row: no self-joins
    rules = I.insight_rules()
    doc = I.summary_columns(frame, k, keep=True).select(
        *k, F.struct(*KPI_FIELDS).alias("kpis"),
        F.struct("headline", "summary_text", "bullets", "recommendations").alias("summary"),
        F.transform(rules, lambda x, i: F.struct(i.alias("pos"), x["type"].alias("type"), x["title"].alias("title"),
                                                 x["detail"].alias("detail"), x["action"].alias("action")))
        .alias("insights"))
    samples = group_top_k(df, k, [F.col("Date"), F.col("Revenue").desc()], SAMPLE_ROWS, "row")
    smp = _collect_per_key(samples, k, "row", "sample_rows")
    schema_map = F.create_map(*[x for r, c in roles.as_dict().items() if r != "standard_columns"
                                for x in (F.lit(r), F.lit(c).cast("string"))])
    doc = doc.join(smp, k, "left").withColumn("schema", schema_map)
    if forecast_summary is not None:
        fs, _ = seg_keys(forecast_summary, user_keys)
        doc = doc.join(fs.select(*k, F.struct("best_model", "horizon", "forecast_sum", "forecast_average",
                                              "message").alias("forecast")), k, "left")
    if forecast_rows is not None:
        fr, _ = seg_keys(forecast_rows, user_keys)
        fr = fr.select(*k, "step", F.date_format("ds", "yyyy-MM-dd").alias("date"), "forecast", "lower", "upper")
        doc = doc.join(_collect_per_key(fr, k, "step", "forecast_rows"), k, "left")
    if comparison is not None:
        cm, _ = seg_keys(comparison, user_keys)
        extra = F.col("extra") if "extra" in cm.columns else F.lit(None).cast("string")
        cm = cm.select(*k, "mape", "model", "mae", "rmse", extra.alias("extra"))  # a row a model
        doc = doc.join(_collect_per_key(cm, k, "mape", "comparison"), k, "left")
    payload = [c for c in doc.columns if c not in k]
    return drop_seg(doc.withColumn("document", F.to_json(F.struct(*payload))))


def insights_from_document(doc: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """List of records back to rows."""
    keys = list(keys)
    return doc.select(*keys, F.inline("insights")).select(*keys, "pos", "type", "title", "detail", "action")


def comparison_from_document(doc: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The model comparison of the JSON text back to rows."""
    keys = list(keys)
    schema = "struct<comparison: array<struct<model: string, mae: double, rmse: double, mape: double, extra: string>>>"
    return doc.select(*keys, F.inline(F.from_json("document", schema)["comparison"]))
