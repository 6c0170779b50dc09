"""Helpers shared by the operators: input tables, written cut points, size estimates."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import ensure_checkpoint_dir

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet under the shared checkpoint folder and read again.

    Cuts the lineage like `checkpoint()`, but column by column and compressed: later steps
    read only the columns they need, and a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def session_settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Sets session settings for the jobs run inside, and puts back what was there."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


#: Most rows of an Arrow batch on its way to a Python worker.
BATCH_ROWS = 512


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, whose session from now on sends at most BATCH_ROWS rows to a Python worker at a time.

    Spark counts rows, not bytes: with its 10,000 rows a batch of long texts would take
    gigabytes in the JVM and in every worker. The plan runs later, so the setting stays.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """`task` (of a mapInArrow), giving back what Arrow's memory pool keeps after each batch that was read.

    The pool keeps freed memory for later, and a Python worker outlives its tasks: without this, idle workers
    hold their largest task's memory while the JVM runs the next stages.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                pa.default_memory_pool().release_unused()
        yield from task(read())
        pa.default_memory_pool().release_unused()
    return run


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text):
    """Lower-case A-Z only. Texts of one byte a character take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, ASCII_UPPER, ASCII_UPPER.lower()))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts (0 for an empty table)."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long")).first()[0]


def power_of_two(n: float, least: int, most: int) -> int:
    """The smallest power of two that is at least `n`, kept within [least, most]."""
    p = least
    while p < n and p < most:
        p *= 2
    return p
