"""Mergeable KPI states: one row per (extra keys, Product, Region, Date), from which every KPI merges.

Raw rows pass one aggregate. A state holds the count, the sum, the mean and the sum of squared
deviations (m2) of the revenue, the profit, and the first and last day; states of any segments, levels,
date ranges or batches merge to states of the same kind, so further questions read states only.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

CELL = ["Product", "Region", "Date"]


def daily_states(clean: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The states of cleaned rows: rows, n (rows with a revenue), total, mean, m2, profit, has_profit, first_ds, last_ds."""
    has_profit = "Profit" in clean.columns
    profit = F.col("Profit").try_cast("double") if has_profit else F.lit(None).cast("double")
    keys = list(dict.fromkeys([*extra, *CELL]))
    base = clean.select(*keys, F.col("Revenue").cast("double").alias("rev"), profit.alias("pr"))
    return base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count("rev").alias("n"), F.sum("rev").alias("total"),
        F.avg("rev").alias("mean"), (F.var_pop("rev") * F.count("rev")).alias("m2"),
        F.sum("pr").alias("profit"), F.lit(has_profit).alias("has_profit")).withColumns(
        {"first_ds": F.col("Date"), "last_ds": F.col("Date")})


def merged() -> dict[str, Column]:
    """Aggregates that merge states into one state.

    m2 = Σ m2ᵢ + Σ nᵢ (meanᵢ − mean)². With k states, the last sum is k · (cov(totalᵢ, meanᵢ) − mean · cov(nᵢ, meanᵢ)),
    whose covariances Spark merges in one pass without subtracting large sums of squares."""
    n, total = F.sum("n"), F.sum("total")
    mean = F.try_divide(total, n)
    between = F.count("mean") * (F.covar_pop("total", "mean") - mean * F.covar_pop(F.when(F.col("n") > 0, F.col("n")), "mean"))
    return {"rows": F.sum("rows"), "n": n, "total": total, "mean": mean,
            "m2": F.sum("m2") + F.greatest(between, F.lit(0.0)), "profit": F.sum("profit"),
            "has_profit": F.max("has_profit"), "first_ds": F.min("first_ds"), "last_ds": F.max("last_ds")}


def merge_states(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One state a value of `keys`."""
    return states.groupBy(*keys).agg(*[c.alias(name) for name, c in merged().items()])


def std_samp(n: Column, m2: Column) -> Column:
    """Sample standard deviation of a state; null below two values."""
    return F.when(n > 1, F.sqrt(m2 / (n - 1)))


def write_states(states: DataFrame, path: str | None = None, mode: str = "append") -> DataFrame:
    """`states` written once and read again.

    With `path` they join the states kept there (a batch adds its own rows for cells that are already
    there: every reader merges), in folders by year and files by ranges of days, so that a date range
    opens only its own files. Without, they go to a new folder under the checkpoint folder."""
    spark = states.sparkSession
    if path is None:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kpi-states-{uuid.uuid4().hex}"
        states.write.parquet(path)
        return spark.read.schema(states.schema).parquet(path)
    (states.withColumn("state_year", F.year("Date")).repartitionByRange("Date", "Product")
     .write.mode(mode).partitionBy("state_year").parquet(path))
    return read_states(spark, path)


def read_states(spark, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The states of the days from `start` to `end` (both included; None: open), read by folder and file ranges."""
    states = spark.read.parquet(path)
    for bound, at in ((start, "start"), (end, "end")):
        if bound is not None:
            day = F.lit(bound).cast("date")
            year = F.col("state_year")
            states = states.where(((year >= F.year(day)) & (F.col("Date") >= day)) if at == "start"
                                  else ((year <= F.year(day)) & (F.col("Date") <= day)))
    return states.drop("state_year")


def level_rollup(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The four levels that a KPI record needs: `level` is total, product, region or day, named in Product_, Region_
    or Date_. Days merge from the states; the other levels from one state a segment, product and region."""
    keys = list(keys)
    nothing = F.lit(None)
    named = states.select(*keys, F.col("Product").alias("Product_"), F.col("Region").alias("Region_"), F.col("Date").alias("Date_"),
                          *[c for c in merged()])
    cells = merge_states(named, [*keys, "Product_", "Region_"])
    by, region = F.grouping("Product_") == 0, F.grouping("Region_") == 0
    wide = (cells.groupingSets([keys, [*keys, "Product_"], [*keys, "Region_"]], *keys, "Product_", "Region_")
            .agg(F.when(by, "product").when(region, "region").otherwise("total").alias("level"),
                 *[c.alias(name) for name, c in merged().items()]))
    levels = wide.select(
        *keys, "level", F.col("Product_").cast("string").alias("Product_"), F.col("Region_").cast("string").alias("Region_"),
        nothing.cast("date").alias("Date_"), F.col("total").alias("rev"), F.col("rows").alias("n"), F.col("mean").alias("avg_rev"),
        std_samp(F.col("n"), F.col("m2")).alias("std_rev"), F.col("profit").alias("profit_sum"), "first_ds", "last_ds", "has_profit")
    days = named.groupBy(*keys, "Date_").agg(F.sum("total").alias("rev")).withColumn("level", F.lit("day"))
    return levels.unionByName(days.select(*[
        F.col(f.name) if f.name in days.columns else nothing.cast(f.dataType).alias(f.name) for f in levels.schema.fields]))
