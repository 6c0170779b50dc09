"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are put into a hash order and their words cut into blocks of
`block_words` words (the last of a source may be shorter). A schedule of slots maps the
golden-ratio points frac(i * phi) through the cumulative shares of the sources, so that every
stretch of the schedule holds the sources in nearly their target shares. The k-th slot of a
source takes its k-th block; past the last block the next pass over the source begins, and
the last slot of a source stops at its target. Slots are joined with the documents' pieces
of the blocks.

All steps are DataFrame operations: slots are ranked in chunks, document positions are
running totals in chunks of the hash order, and a slot finds its source through bins of [0, 1),
so neither a hot source nor a large number of sources meets in one task.

Defined results: a null text has no words; documents without words are in no block and have
taken = 0; a null source is a source of its own, the last one; rows that repeat an identifier
count as separate documents; an empty table gives an empty result. Equal input gives an equal
result on every run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.plans.ordering import with_row_index

from .running import running_total
from .tables import written

SPACE = " \t\n\x0b\x0c\r"
#: Rows of one chunk of a ranked or summed sequence.
CHUNK_ROWS = 1 << 15
PHI = 0.6180339887498949


def word_count(text):
    """Words of a text: runs of characters other than space and 0x09-0x0D; null has none."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(F.coalesce(F.octet_length(trimmed), F.lit(0)) == 0, F.lit(0)).otherwise(
        F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """(id, source, size, row_hash, copy): one slim row a document; `copy` numbers the rows that
    are equal in all three columns."""
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"),
                       word_count(F.col(f"`{text_col}`")).alias("size"),
                       row_hash(docs).alias("row_hash"))
    same = Window.partitionBy("row_hash", "id").orderBy("source", "size")
    return slim.withColumn("copy", F.row_number().over(same))


def row_hash(docs: DataFrame):
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def source_targets(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """One row a source: source_no (by code point, null last), source, source_size, target.

    The sources weigh `weights`, repeating, and share `share` times all words; a target stops
    at `most` times its source's words and the excess is reshared by weight until none is above.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = with_row_index(sums.withColumn("is_null", F.col("source").isNull()),
                              ["is_null", "source"], "source_no").drop("is_null", "row_total")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = written(numbered.withColumn("weight", F.get(cycle, F.pmod("source_no", F.lit(len(weights))).cast("int")))
                      .withColumn("cap", F.col("source_size") * F.lit(float(most))), "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    # the level: a source gets least(cap, level * weight). It only rises while sources reach
    # their caps, so the loop ends after as many steps as sources change sides.
    level, above = 0.0, -1
    while True:
        full = F.col("cap") < F.lit(level) * F.col("weight")
        got = sources.agg(F.count_if(full).alias("n"),
                          F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("cap"),
                          F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weight")).first()
        if got.n == above or not got.weight:
            break
        above, level = got.n, (share * total - got.cap) / got.weight
    return sources.withColumn("target", F.least("cap", F.lit(level) * F.col("weight"))).drop("cap", "weight")


def _schedule(sources: DataFrame, block_words: int) -> DataFrame:
    """(slot, source_no, visit): `visit` counts a source's slots from 0."""
    spark = sources.sparkSession
    whole = F.floor("target").cast("long")
    need = sources.where("source_size > 0 AND target >= 1").select(
        "source_no", (F.expr("div(cast(floor(target) as bigint), source_size)")
                      * F.ceil(F.col("source_size") / block_words)
                      + F.ceil(F.pmod(whole, F.col("source_size")) / block_words)).cast("long").alias("slots"),
        F.expr(f"div(source_no, {CHUNK_ROWS})").alias("part"))
    need = written(running_total(need.withColumn("all", F.lit(0)), ["all"], "part", ["source_no"], "slots", "before"),
                   "mix-need")
    n_slots, n_sources = need.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count(F.lit(1))).first()
    bins = max(1024, 4 * n_sources)
    # frac(i * phi), in two parts so that large i keep their precision
    hi, lo = F.expr("div(slot, 1048576)"), F.expr("pmod(slot, 1048576)")
    raw = hi * F.lit((1048576 * PHI) % 1.0) + lo * F.lit(PHI)
    points = (spark.range(n_slots).withColumnRenamed("id", "slot")
              .withColumn("at", (raw - F.floor(raw)) * F.lit(float(n_slots)))
              .withColumn("bin", F.floor(F.col("at") * bins / F.lit(float(max(n_slots, 1)))).cast("long")))
    edge = F.lit(float(max(n_slots, 1)))
    spans = need.select("source_no", F.col("before").alias("from"), (F.col("before") + F.col("slots")).alias("to")).select(
        "source_no", "from", "to",
        F.explode(F.sequence(F.floor(F.col("from") * bins / edge).cast("long"),
                             F.floor(F.col("to") * bins / edge).cast("long"))).alias("bin"))
    hits = (points.join(spans, "bin").where("at >= from AND at < to")
            .select("slot", "source_no", F.expr(f"div(slot, {CHUNK_ROWS})").alias("part"), F.lit(1).alias("one")))
    ranked = running_total(hits, ["source_no"], "part", ["slot"], "one", "visit").select("slot", "source_no", "visit")
    # the points miss a source's exact count by a few slots: these close the schedule
    got = hits.groupBy("source_no").agg(F.count(F.lit(1)).alias("got"))
    closing = (need.join(got, "source_no", "left").withColumn("got", F.coalesce("got", F.lit(0)))
               .where("got < slots")
               .select("source_no", F.explode(F.expr("sequence(got, slots - 1)")).alias("visit"))
               .select((F.lit(n_slots) + F.col("source_no")).alias("slot"), "source_no", "visit"))
    return (ranked.unionByName(closing).join(need.select("source_no", "slots"), "source_no")
            .where("visit < slots").drop("slots"))


def mix(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
        block_words: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Mixes the documents of `rows` (as `sized` gives them; written beforehand, as it is read
    several times).

    Returns (schedule, documents). schedule: slot, pass, source, id, row_hash, copy, from_word,
    words: the pieces of documents that each slot takes, in their order. documents: id, source,
    row_hash, copy, size, source_size, target, taken.
    """
    sources = written(source_targets(rows, weights, share, most), "mix-targets")
    n_rows = rows.count()
    chunks = max(16, n_rows // CHUNK_ROWS)
    ordered = rows.withColumn("order", F.xxhash64("row_hash", "id", "copy")).withColumn(
        "chunk", F.floor((F.col("order") / F.lit(2.0 ** 64) + 0.5) * chunks).cast("long"))
    placed = running_total(ordered, ["source"], "chunk", ["order", "id", "copy"], "size", "start")
    known = sources.withColumnRenamed("source", "named")
    placed = written(placed.join(known, F.col("source").eqNullSafe(F.col("named")))
                     .drop("named", "order", "chunk"), "mix-placed")

    visits = _schedule(sources, block_words).join(sources.select("source_no", "source_size", "target"), "source_no")
    per_pass = F.ceil(F.col("source_size") / block_words).cast("long")
    visits = (visits.withColumn("pass", F.floor(F.col("visit") / per_pass).cast("long"))
              .withColumn("block", F.col("visit") - F.col("pass") * per_pass)
              .withColumn("limit", F.least(F.floor("target").cast("long") - F.col("pass") * F.col("source_size"),
                                           F.col("source_size")))
              .select("slot", "pass", "source_no", "block", "limit"))
    pieces = (placed.where("size > 0")
              .withColumn("block", F.explode(F.expr(f"sequence(div(start, {block_words}), div(start + size - 1, {block_words}))")))
              .withColumn("lo", F.greatest("start", F.col("block") * block_words))
              .withColumn("hi", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)))
    taken = (pieces.join(visits, ["source_no", "block"])
             .withColumn("words", F.least("hi", "limit") - F.col("lo")).where("words > 0"))
    schedule = taken.select("slot", "pass", "source", "id", "row_hash", "copy",
                            (F.col("lo") - F.col("start")).alias("from_word"), "words")
    sums = taken.groupBy(F.col("row_hash").alias("t_hash"), F.col("id").alias("t_id"),
                         F.col("copy").alias("t_copy")).agg(F.sum("words").alias("got"))
    same = ((F.col("row_hash") == F.col("t_hash")) & (F.col("copy") == F.col("t_copy"))
            & F.col("id").eqNullSafe(F.col("t_id")))
    documents = placed.join(sums, same, "left").select(
        "id", "source", "row_hash", "copy", "size", "source_size", "target",
        F.coalesce("got", F.lit(0)).cast("long").alias("taken"))
    return schedule, documents


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    **how) -> DataFrame:
    """The mix as documents with docs' own columns: one row, with its whole text, for every pass over a document
    that the mix takes words from. The last document of a source, which its target would cut, is whole as well,
    so a source goes over its target by less than one document."""
    schedule, _ = mix(written(sized(docs, id_col, text_col, source_col), "mix-sized"), **how)
    passes = schedule.groupBy(F.col("row_hash").alias("t_hash"), F.col("id").alias("t_id"), F.col("copy").alias("t_copy"),
                              "pass").agg(F.sum("words").alias("words"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_hash(docs).alias("row_hash"),
                       F.col(f"`{id_col}`").alias("id"))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("row_hash", "id").orderBy("row_hash")))
    same = ((F.col("row_hash") == F.col("t_hash")) & (F.col("copy") == F.col("t_copy"))
            & F.col("id").eqNullSafe(F.col("t_id")))
    return rows.join(passes, same).select("row.*")
