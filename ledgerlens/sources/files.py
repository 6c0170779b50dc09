"""Uploads as files: format dispatch, CSV scan, ingest manifest and cleaned-data sinks
(S1, S3, S6, S7, S9)."""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .xlsx import read_xlsx

SUPPORTED = (".csv", ".xlsx", ".parquet")


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Header row, inferred types (one extra pass) unless a schema is given."""
    r = spark.read.option("header", True)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


def read_upload(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """S3: pick the reader from the suffix (or `fmt`); anything else is rejected."""
    kind = (fmt or os.path.splitext(path.rstrip("/*"))[1] or "").lower().lstrip(".")
    if kind == "csv":
        return read_csv(spark, path)
    if kind == "xlsx":
        return read_xlsx(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported upload format {kind!r}: only CSV and Excel (.xlsx) files are allowed")


def ingest_manifest(raw: DataFrame) -> DataFrame:
    """One `FileRecord` per input file: path, filename, rows, columns, uploaded_at.

    Uses the file-source `_metadata` column, so it works for any number of files; files of
    one name in different folders stay apart.
    """
    cols = F.array(*[F.lit(c) for c in raw.columns])
    return (raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("filename"))
            .groupBy("path", "filename").agg(F.count(F.lit(1)).alias("rows"))
            .select("path", "filename", "rows", cols.alias("columns"),
                    F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("uploaded_at")))


def listed_files(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """Every file under `path` (no contents are read): path, filename, length, modified."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path)
             .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("filename"),
                     F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_modification_time").alias("modified")))
    return files


LEDGER = ("path string, filename string, length long, modified timestamp, rows long, columns array<string>, uploaded_at timestamp")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The records taken so far; none if nothing is there yet."""
    reader = spark.read.schema(LEDGER)
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def take_files(spark: SparkSession, folder: str, ledger_path: str, fmt: str = "csv") -> DataFrame:
    """Records the files of `folder` that the ledger does not have yet, and returns those records.

    A file is known by path, length and time of change. The listing is joined with the row counts,
    so a file without data rows has its record (0 rows) as well."""
    new = listed_files(spark, folder, f".{fmt}").join(
        ledger(spark, ledger_path).select("path", "length", "modified"), ["path", "length", "modified"], "left_anti")
    new = new.persist()  # the listing: one row a file
    try:
        paths = [r.path for r in new.select("path").toLocalIterator()]
        if paths:
            raw = spark.read.parquet(*paths) if fmt == "parquet" else spark.read.option("header", True).csv(paths)
            counts = raw.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"))
            columns = F.array(*[F.lit(c) for c in raw.columns])
            records = new.join(counts, "path", "left").select(
                "path", "filename", "length", "modified", F.coalesce("rows", F.lit(0)).alias("rows"), columns.alias("columns"),
                F.current_timestamp().alias("uploaded_at"))
            records.write.mode("append").parquet(ledger_path)
        taken = spark.createDataFrame([(p,) for p in paths], "path string")
    finally:
        new.unpersist()
    return ledger(spark, ledger_path).join(taken, "path", "left_semi")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder (never a machine-local temp
    dir), so that runs that share the folder do not overwrite each other."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/ledgerlens/{name}-{uuid.uuid4().hex}"


def write_cleaned(df: DataFrame, path: str, fmt: str = "csv", partition_by_month: bool = False) -> None:
    """Cleaned rows with a header (CSV) or as Parquet, optionally partitioned by year/month
    so later segment filters on time prune files."""
    w = df
    if partition_by_month:
        # own names: `month` would clash with the cleaned `Month` (names are case-insensitive)
        w = df.withColumn("part_year", F.year("Date")).withColumn("part_month", F.month("Date"))
    writer = w.write.mode("overwrite")
    if partition_by_month:
        writer = writer.partitionBy("part_year", "part_month")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def materialize_cleaned(df: DataFrame, path: str) -> DataFrame:
    """Write cleaned rows once as year/month-partitioned Parquet and read them back.

    Every dashboard operator starts from the cleaned table; at scale the star join and the
    cleaner should run once, and later segment or date filters prune partitions and
    columns at the scan instead of re-running the joins.
    """
    write_cleaned(df, path, fmt="parquet", partition_by_month=True)
    return df.sparkSession.read.parquet(path).drop("part_year", "part_month")


def sample_rows(df: DataFrame, n: int = 10, order_by=("Date",)) -> DataFrame:
    """The first n rows in `order_by` order (a distributed top-n; file order has no
    meaning in Spark, so the preview is defined by date, ties by the further columns)."""
    return df.orderBy(*[F.col(c) if isinstance(c, str) else c for c in order_by]).limit(n)
