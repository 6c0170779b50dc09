"""Uploads arriving in a folder, processed with the same operators as a batch upload.

The reference analyses one finished file per request and has no streaming semantics; this
module only applies the stateless cleaner to a file stream and keeps the per-segment daily
revenue (A5) up to date, so repeated uploads need not be re-read. The cleaner's missing-date
fallback needs a row order over the whole file and is refused on streams.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import clean_sales
from ..operators.schema_map import detect_roles


def upload_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv",
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """A file-source stream of uploads (schema fixed beforehand, as streams require)."""
    r = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        r = r.option("header", True)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def clean_stream(raw: DataFrame) -> DataFrame:
    """P14 on a stream: every step is a per-row projection or filter."""
    if detect_roles(raw).date_col is None:
        raise ValueError("a streamed upload needs a date column (the fallback needs a row order)")
    return clean_sales(raw)[0]


def daily_revenue_stream(clean: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Running revenue per segment and day; emit with output mode `update` or `complete`.

    State is one row per (segment, day), bounded by the calendar, so no watermark is set:
    historic uploads may arrive at any time and still land in the right day.
    """
    return clean.groupBy(*keys, F.col("Date").alias("ds")).agg(F.sum("Revenue").alias("y"),
                                                               F.count(F.lit(1)).alias("rows"))
