"""Skew-safe top-k per group: salted local top-k, then a top-k over the survivors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def group_top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                rank_col: str = "rank", salts: int = SALTS) -> DataFrame:
    """The first `k` rows of every group by `order`.

    Whole table: a distributed TakeOrderedAndProject. Per group: rows are salted by a
    content hash (deterministic, so a recomputed task makes the same choice), each
    (group, salt) keeps its own top k, and the final ranking sees at most k × salts rows per
    group — a group holding a third of the table never lands in one task.
    """
    keys = list(keys)
    if not keys:
        top = df.orderBy(*order).limit(k)
        return top.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salts))
    local = Window.partitionBy(*keys, "__salt").orderBy(*order)
    cand = (df.withColumn("__salt", salt).withColumn("__r", F.row_number().over(local))
            .where(F.col("__r") <= k).drop("__r", "__salt"))
    final = Window.partitionBy(*keys).orderBy(*order)
    return cand.withColumn(rank_col, F.row_number().over(final)).where(F.col(rank_col) <= k)
