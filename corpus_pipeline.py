"""The corpus pipeline: five stages over `documents`, each written and read again.

quality classifier -> exact dedup -> near-duplicate groups -> mixing -> byte-level BPE.
Every stage works on all its predecessor kept. All but the last return the columns of
`documents`. Null texts count as empty in every stage; an empty table stays empty.

run() applies the stages to `documents`. The result cannot be written in SQL (classifier
weights, token ids), so it is tested against a plain version of each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import byte_bpe, exact_dedup, mixing, ngram_join, quality
from ledgerlens.llm.catalog import tokenizer_file
from ledgerlens.llm.tables import read_table, written

ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling against the labelled good ones keeps."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for the case of A-Z) the document with the largest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 Jaccard similarity of five-word shingles the smallest doc_id stays."""
    return ngram_join.one_of_each_group(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every pass over a source that the mix takes words from gives a row a document: whole, or
    the words up to the source's target."""
    return mixing.mixed_documents(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, decoded again: doc_id, n_tokens, ids_sha256, decoded_sha256, n_split."""
    return byte_bpe.round_trip(docs, tokenizer_file("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE", encode_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each result but the last is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
