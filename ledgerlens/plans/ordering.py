"""Distributed consecutive row numbering without a single-partition window."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sampled rows a range; the sample (of so many rows times the ranges) only shapes the ranges.
SAMPLED = 40


def _content_hash(df: DataFrame) -> Column:
    """A hash of the whole row (columns that cannot be hashed, such as maps, by their JSON text)."""
    def part(f: T.StructField) -> Column:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        return F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() else c
    return F.xxhash64(*[part(f) for f in df.schema.fields])


def _range_of(key: Column, splitters: list[T.Row], key_type: T.StructType) -> Column:
    """How many of the sorted splitters are at or below `key`, by binary search."""
    if not splitters:
        return F.lit(0)
    fields = [F.array(*[F.lit(row[i]).cast(f.dataType) for row in splitters]).alias(f.name) for i, f in enumerate(key_type.fields)]
    table = F.arrays_zip(*fields)
    n = len(splitters)

    def halve(acc, _):
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        below = F.get(acc["table"], middle) <= acc["key"]
        searching = acc["low"] < acc["high"]
        return F.struct(acc["table"].alias("table"), acc["key"].alias("key"),
                        F.when(searching & below, middle + 1).otherwise(acc["low"]).alias("low"),
                        F.when(searching & ~below, middle).otherwise(acc["high"]).alias("high"))
    init = F.struct(table.alias("table"), key.alias("key"), F.lit(0).alias("low"), F.lit(n).alias("high"))
    return F.aggregate(F.array_repeat(F.lit(0), math.ceil(math.log2(n + 1)) + 1), init, halve, lambda acc: acc["low"])


def with_row_index(df: DataFrame, order_by: Sequence[str], name: str = "row_idx") -> DataFrame:
    """Add a 0-based consecutive index in `order_by` order (`row_total`: the number of rows).

    Rows of equal keys are ordered by a hash of the whole row, so keys that most rows share are spread
    over ranges like any others (rows that are equal throughout are interchangeable). The ranges come
    from splitters in a bounded sample, so a row's range depends on the row alone: the pass that counts
    the ranges and the pass that numbers the rows agree without a copy of the raw rows, also after a
    lost executor. The only window over all ranges has one row a range.
    """
    names = [c for c in order_by]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("__hash", _content_hash(df))
    key_type = T.StructType([T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(names)]
                            + [T.StructField("k", T.LongType())])
    key_columns = [*[F.col(c).alias(f"k{i}") for i, c in enumerate(names)], F.col("__hash").alias("k")]
    # rows of least hash (salted): a sample of distinct rows whose size does not follow the input's
    sample = keyed.select(*key_columns).orderBy(F.xxhash64("k", F.lit(7))).limit(SAMPLED * parts)
    ranked = sorted(sample.distinct().collect(), key=lambda r: tuple((v is not None, v) for v in r))
    splitters = [ranked[i * len(ranked) // parts] for i in range(1, parts)] if len(ranked) >= parts else ranked[1:]
    placed = keyed.withColumn("__range", _range_of(F.struct(*key_columns), splitters, key_type))
    counts = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__count"))
    w = Window.orderBy("__range")  # one row a range
    offsets = counts.select("__range", F.coalesce(F.sum("__count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"),
                            F.sum("__count").over(Window.partitionBy(F.lit(1))).alias("row_total"))
    inside = Window.partitionBy("__range").orderBy(*[F.col(c) for c in names], "__hash")
    return (placed.withColumn("__rn", F.row_number().over(inside) - 1).join(F.broadcast(offsets), "__range")
            .withColumn(name, F.col("__off") + F.col("__rn")).drop("__range", "__rn", "__off", "__hash"))
