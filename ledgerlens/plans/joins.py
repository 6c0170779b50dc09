"""A constant segment key for whole-table results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALL_KEY = "__segment"


def seg_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Give a frame a grouping key: the user's keys, or one constant key for the whole table.

    With the constant key every per-segment result is a one-row frame, so whole-table and
    segmented KPIs share one code path and the final equi-joins stay one row per side.
    """
    keys = list(keys)
    if keys:
        return df, keys
    return df.withColumn(ALL_KEY, F.lit(0)), [ALL_KEY]


def drop_seg(df: DataFrame) -> DataFrame:
    return df.drop(ALL_KEY) if ALL_KEY in df.columns else df
