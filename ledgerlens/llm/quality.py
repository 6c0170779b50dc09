"""Quality classifier by importance resampling.

Two generative models over hashed byte n-grams, one of the target text (documents labelled
good) and one of all text, give every document a log importance weight: the mean log ratio
of its n-grams, shrunk for short texts. Documents are then sampled without replacement in
proportion to their (tempered) weights by Gumbel top-k: each document's key is its scaled log
weight plus Gumbel noise, and the k largest keys are kept. The noise comes from a hash of
the identifier, so reruns agree. At the default scale (`TEMPER`) the noise decides only among documents
within about 0.02 of the cut: the sample is then nearly the plain cut, which is what a filter of junk needs;
a smaller scale samples more freely.

The raw model counts every document's whole text. The target model is fitted on a bounded
sample of labelled documents (`LABELLED`), half of which calibrate k: a cut of the
weights is chosen at a price of `GOOD_COST` junk documents for one good one, in the middle of
the gap where it falls; k is the number of documents that reach it.

Defined results: a null or empty text has log weight 0 (neither good nor bad evidence);
without any good or any bad labelled document every document is kept; rows with equal keys
at the cut are all kept; repeated labels of a document are averaged (0.5 and more is good);
null labels and null identifiers in labels are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import lean, small_batches, written
from .words import slices

#: Labelled documents that are used: those with the smallest hash of their identifier.
LABELLED = 20_000
#: Hashed buckets of the n-grams of `NGRAM` bytes.
BUCKETS = 1 << 16
NGRAM = 4
#: n-grams of average text that every document is assumed to have besides its own.
PRIOR_NGRAMS = 64
#: Scale of the log weights against the Gumbel noise.
TEMPER = 400.0
GOOD_COST = 20


def ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every run of NGRAM bytes of each text; texts of 1 to 3 bytes
    are padded with spaces."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    column = pc.if_else(pc.and_(pc.greater(pc.binary_length(column), 0), pc.less(pc.binary_length(column), NGRAM)),
                        pc.binary_join_element_wise(column, pa.scalar(b"   ", pa.large_binary()),
                                                    pa.scalar(b"", pa.large_binary())), column)
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    raw = column.buffers()[2]
    data = (np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8))[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    if len(data) < NGRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = data.astype(np.uint32)
    gram = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
    bucket = (gram * np.uint32(2654435761)) >> np.uint32(16)
    text = np.repeat(np.arange(n), np.diff(offsets))
    whole = text[:-3] == text[3:]
    return text[:-3][whole], bucket[whole].astype(np.int64)


def labelled_sample(labels: DataFrame, label: str, id_col: str = "doc_id", most: int = LABELLED) -> DataFrame:
    """(label_id, good 0/1, role): at most `most` labelled documents by the hash of their
    identifier; role 0 fits, role 1 calibrates."""
    each = (labels.select(F.col(f"`{id_col}`").alias("label_id"), F.col(f"`{label}`").cast("double").alias("y"))
            .where("label_id is not null and y is not null and not isnan(y)")
            .groupBy("label_id").agg(F.avg("y").alias("y")))
    order = F.xxhash64("label_id")
    return (each.orderBy(order, "label_id").limit(most)
            .select("label_id", (F.col("y") >= 0.5).cast("int").alias("good"),
                    F.pmod(F.xxhash64("label_id", F.lit(1)), F.lit(2)).cast("int").alias("role")))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id",
        text_col: str = "text") -> np.ndarray | None:
    """Log ratio of target to raw probability of each bucket; None without both labels."""
    sample = written(labelled_sample(labels, label, id_col), "quality-labels")
    if sample.agg(F.count_distinct("good")).first()[0] < 2:
        return None
    # at most LABELLED rows of a few bytes
    joined = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(
        F.broadcast(sample), F.col("id") == F.col("label_id"), "left").select(
        "text", (F.coalesce((F.col("good") == 1) & (F.col("role") == 0), F.lit(False))).alias("target"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            is_target = batch.column("target").to_numpy(zero_copy_only=False)
            for a, b in slices(batch.column("text")):
                text, bucket = ngrams(batch.column("text").slice(a, b - a))
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[is_target[a:b][text]], minlength=BUCKETS)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(raw[seen]), pa.array(target[seen])],
                                         names=["bucket", "raw", "target"])

    sums = (small_batches(joined).mapInArrow(lean(count), "bucket int, raw long, target long")
            .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))).toPandas()  # BUCKETS rows
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    raw[sums["bucket"]] += sums["raw"]
    target[sums["bucket"]] += sums["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def with_log_weight(docs: DataFrame, ratio: np.ndarray, text_col: str = "text", out: str = "log_weight") -> DataFrame:
    """`docs` with the documents' log importance weights as column `out`."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            column = batch.column(text_col)
            weight = np.zeros(batch.num_rows)
            for a, b in slices(column):
                text, bucket = ngrams(column.slice(a, b - a))
                total = np.bincount(text, ratio[bucket], minlength=b - a)
                weight[a:b] = total / (np.bincount(text, minlength=b - a) + PRIOR_NGRAMS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weight)], names=[*batch.schema.names, out])

    return small_batches(docs).mapInArrow(lean(weigh), T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def gumbel_key(id_col, log_weight):
    """The sampling key: scaled log weight plus Gumbel noise from the identifier's hash."""
    uniform = (F.pmod(F.xxhash64(id_col, F.lit(2)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return TEMPER * log_weight - F.log(-F.log(uniform))


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest of a column: counts in ever narrower bins, then a look at one bin."""
    lo, hi = values.agg(F.min(column), F.max(column)).first()
    above = 0  # rows beyond the current bin
    while True:
        inside = values.where((F.col(column) >= lo) & (F.col(column) <= hi))
        width = (hi - lo) / bins
        if width <= abs(hi) * 1e-15 or inside.count() <= bins:
            break
        at = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1))
        counts = dict(inside.groupBy(at.alias("bin")).count().collect())  # at most `bins` rows
        for b in sorted(counts, reverse=True):
            if above + counts[b] >= k:
                # a little wider, so that rounding at the borders loses no row
                top = inside.where(at == b).agg(F.min(column), F.max(column)).first()
                lo, hi = top[0], top[1]
                above = values.where(F.col(column) > hi).count()
                break
            above += counts[b]
        if lo == hi:
            return lo
    if hi - lo <= abs(hi) * 1e-15 * bins and inside.count() > bins:
        return lo
    rest = sorted((r[0] for r in inside.select(column).collect()), reverse=True)  # at most `bins` rows
    return rest[k - above - 1]


def resample(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id",
             text_col: str = "text") -> tuple[np.ndarray | None, float, float]:
    """Fits and calibrates: (log ratios, least weight of calibrated good documents, cut of the
    keys). Documents with a key of at least the cut are the sample."""
    ratio = fit(docs, labels, label, id_col, text_col)
    if ratio is None:
        return None, float("-inf"), float("-inf")
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    weights = written(with_log_weight(slim, ratio).select("id", "log_weight"), "quality-weights")
    sample = labelled_sample(labels, label, id_col).where("role = 1")
    known = weights.join(F.broadcast(sample), F.col("id") == F.col("label_id")).select("log_weight", "good").toPandas()
    known = known.sort_values("log_weight", kind="stable")
    good = known["good"].to_numpy() == 1
    if good.all() or not good.any():
        return ratio, float("-inf"), float("-inf")
    # price of a cut just below each labelled document: good ones lost, junk kept
    price = GOOD_COST * (np.cumsum(good) - good) + (np.cumsum(~good[::-1])[::-1])
    weight, best = known["log_weight"].to_numpy(), int(np.argmin(price))
    least = float((weight[max(best - 1, 0)] + weight[best]) / 2)
    k = weights.where(F.col("log_weight") >= least).count()
    keys = weights.select(gumbel_key(F.col("id"), F.col("log_weight")).alias("key"))
    return ratio, least, kth_largest(keys, "key", k)


def _weighed(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str) -> DataFrame:
    """Two struct columns: `row` (docs' own columns) and `importance` (log_weight, sample_key and kept)."""
    ratio, _, cut = resample(docs, labels, label, id_col, text_col)
    if ratio is None:
        ratio = np.zeros(BUCKETS)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    weighed = with_log_weight(rows, ratio)
    key = gumbel_key(F.col("id"), F.col("log_weight"))
    return weighed.select("row", F.struct("log_weight", key.alias("sample_key"), (key >= F.lit(cut)).alias("kept")).alias("importance"))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """`docs` with log_weight, sample_key and kept (struct column `importance`, in place of one of that name)."""
    columns = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() != "importance"]
    return _weighed(docs, labels, label, id_col, text_col).select(*columns, "importance")


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """The documents that are sampled, with docs' own columns, whatever their names."""
    return _weighed(docs, labels, label, id_col, text_col).where("importance.kept").select("row.*")
