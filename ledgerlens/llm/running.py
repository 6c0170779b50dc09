"""Running totals over groups of any size, without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str],
                  value: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same `keys` that come earlier by
    (chunk, order).

    A window sums inside each (keys, chunk); the totals of the chunks, one row each, are
    summed by a second window and joined back. A group that holds a third of the table is
    so spread over its chunks. `df` is read twice and must give the same rows both times.
    """
    keys = list(keys)
    totals = df.groupBy(*keys, chunk).agg(F.sum(value).alias("__total"))
    totals = totals.select(
        *[F.col(k).alias(f"__{k}") for k in [*keys, chunk]],
        F.coalesce(F.sum("__total").over(
            Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    match = F.col(chunk) == F.col(f"__{chunk}")
    for k in keys:
        match &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return (rows.join(totals, match).withColumn(out, (F.col("__before") + F.col("__inside")).cast("long"))
            .drop("__before", "__inside", *[f"__{k}" for k in [*keys, chunk]]))
