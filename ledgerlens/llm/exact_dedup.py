"""Exact dedup by content sort.

Rows are dealt to ranges of their normalised bytes (A-Z lower-cased; null counts as empty),
with range borders that Spark samples from the data; each range is sorted externally, so
equal texts become neighbours; and a window over the full text compares neighbours byte by
byte and keeps one identifier of each run.

Range borders are tuples (first bytes, 64-bit hash, salt), so the driver never holds whole
texts. A text that would fill more than about half of a mean range is found in a sample
beforehand; its rows get a salt, spread over many ranges, and the totals of these few texts
come from one map-side aggregation. The sample only decides where rows go. The result is
the same with any sample.

Defined results: rows with a null identifier take part, and stay only if all of the group's
identifiers are null (one such row stays); rows that repeat an identifier and text are one
group, of which one row stays; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import ascii_lower, shuffle_partitions

#: Bytes of a text in a range border, and salts of a text that is spread over ranges.
PREFIX_BYTES = 32
SALTS = 1024
#: Rows sampled for each range, and how many of them make a text too large for one range.
SAMPLED_PER_RANGE = 64
LARGE_IN_SAMPLE = 32


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               ranges: int | None = None) -> DataFrame:
    """Every row of `docs` with its group: (row struct<docs' columns>, keep_id, group_size,
    kept, text_sha256). The row with the largest identifier of equal texts is kept."""
    ranges = ranges or shuffle_partitions(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(f"`{id_col}`").alias("id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    keyed = (rows.withColumn("norm", normalised(F.col("text")))
             .withColumn("prefix", F.substring(F.encode("norm", "UTF-8"), 1, PREFIX_BYTES))
             .withColumn("hash", F.xxhash64("norm")))
    large = _large_texts(keyed, docs.count(), ranges)
    totals = (keyed.join(F.broadcast(large), ["prefix", "hash"], "left_semi")
              .groupBy("norm").agg(F.max("id").alias("all_keep"), F.count(F.lit(1)).alias("all_size"))
              .select(F.sha2("norm", 256).alias("text_sha256"), "all_keep", "all_size"))

    dealt = (keyed.drop("norm").join(F.broadcast(large.withColumn("large", F.lit(True))),
                                     ["prefix", "hash"], "left")
             .withColumn("salt", F.when(F.col("large"), F.pmod(F.xxhash64("id"), F.lit(SALTS)))
                         .otherwise(F.lit(0)))
             .repartitionByRange(ranges, "prefix", "hash", "salt")
             .withColumn("norm", normalised(F.col("text"))))
    run = Window.partitionBy("prefix", "hash", "salt", "norm")
    in_run = dealt.select(
        "row", "id", "large", F.sha2("norm", 256).alias("text_sha256"),
        F.max("id").over(run).alias("run_keep"), F.count(F.lit(1)).over(run).alias("run_size"),
        F.row_number().over(run.orderBy(F.col("id").desc_nulls_last())).alias("place"))
    # one row a large text: at most 2 * ranges of them (see _large_texts)
    out = in_run.join(F.broadcast(totals.withColumn("large", F.lit(True))),
                      ["large", "text_sha256"], "left")
    keep = F.when(F.col("large"), F.col("all_keep")).otherwise(F.col("run_keep"))
    size = F.when(F.col("large"), F.col("all_size")).otherwise(F.col("run_size"))
    return out.select("row", "id", keep.alias("keep_id"), size.cast("long").alias("group_size"),
                      ((F.col("place") == 1) & F.col("id").eqNullSafe(keep)).alias("kept"), "text_sha256")


def _large_texts(keyed: DataFrame, n_rows: int, ranges: int) -> DataFrame:
    """(prefix, hash) of texts that hold more than about half of a mean range: by sampling
    `SAMPLED_PER_RANGE * ranges` rows, so at most 2 * ranges keys."""
    share = min(1.0, SAMPLED_PER_RANGE * ranges / max(n_rows, 1))
    bits = 1 << 30
    return (keyed.where(F.pmod(F.xxhash64("id", F.octet_length("text"), F.lit(1)), F.lit(bits)) < int(share * bits))
            .groupBy("prefix", "hash").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= LARGE_IN_SAMPLE).select("prefix", "hash"))


def dedup_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, dropped ones too: identifier, keep_id, group_size, kept, text_sha256."""
    slim = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias(text_col))
    return dedup_rows(slim, id_col, text_col).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with docs' own columns."""
    kept = dedup_rows(docs, id_col, text_col).where("kept")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
