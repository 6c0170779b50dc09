"""Queries of the operators in this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann_tree, byte_bpe, decontaminate, exact_dedup, merkle, mixing, ngram_join, quality, ranked_search,
               secret_scan, simple8b, substring_dedup, toxicity)
from .tables import read_table, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(mixing.sized(read_table(spark, sf_dir, "documents")), "mix-sized")
    _, documents = mixing.mix(rows)
    return documents.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def tokenizer_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op2_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = simple8b.write_ids(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2)
    return simple8b.read_ids(files, with_ids=False).withColumnRenamed("id", "doc_id")


def op3_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_tree.nearest_neighbours(read_table(spark, sf_dir, "embeddings"), "id % 100 = 0", k=10)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two annotated categories as a chain: junk text first, whose odds the toxicity model sees."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    scored = toxicity.classify(read_table(spark, sf_dir, "documents"), labels, ["low_quality", "toxic"])
    return scored.select("doc_id", "toxic", "p_toxic", "p_low_quality")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_groups(read_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(read_table(spark, sf_dir, "documents"), width=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read_table(spark, sf_dir, "documents"), width=4, percent=85)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] < 3)

    def count(kind: int):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(secret_scan.as_text(base), 256).alias("base_sha256"),
                        secret_scan.as_text(F.col("spans")).alias("spans"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, read_table(spark, sf_dir, "labels")).select("doc_id", "importance.*")


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"),
                                        width=10, slop=5)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"),
                        F.size("near_items").cast("long").alias("n_near_items"))


def op12_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=20)


def tampered_count() -> Column:
    """n_chars, one more where 7 divides the CRC-32 of the decimal doc_id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return F.when(hit, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars")).cast("decimal(21,0)")


def merkle_digest(docs: DataFrame) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    out = merkle.manifest(docs, fields, "doc_id", "lang", {"n_chars": tampered_count()})

    def hexed(c: str) -> Column:
        return F.lower(F.hex(c)).alias(c)
    proof = F.array_join(F.transform("proof", lambda h: F.lower(F.hex(h))), "")
    return out.select("doc_id", hexed("leaf"), hexed("subroot"), hexed("root"), F.sha2(proof, 256).alias("proof_sha256"),
                      hexed("folded_root"), "verified")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_digest(read_table(spark, sf_dir, "documents"))


OP6_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm)
"""
_LOWERED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"

OP11_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
item AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') AS words
         FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(s) WHERE len(w) > 0),
near AS (SELECT DISTINCT item_id, k, list_distinct(string_split(words, ' ')) AS need FROM item),
place AS (SELECT r, s, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS words
          FROM d, (SELECT DISTINCT k FROM item), unnest(range(1, len(w) - k + 2)) AS t(s)),
hit AS (SELECT r, item_id, s, item.k AS k FROM place JOIN item USING (words)),
word_at AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
rarest AS (SELECT item_id, k, need, arg_min(x, coalesce(n, 0)) AS word FROM (SELECT item_id, k, need, unnest(need) AS x FROM near)
           LEFT JOIN (SELECT word AS x, count(*) AS n FROM word_at GROUP BY word) USING (x) GROUP BY ALL),
close AS (SELECT DISTINCT r, item_id FROM rarest JOIN word_at USING (word) JOIN d USING (r),
          unnest(range(greatest(p - k - 4, 1), p + 1)) AS t(s) WHERE list_has_all(list_slice(w, s, s + k + 4), need)),
found AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
          FROM hit GROUP BY r),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM hit, unnest(range(s, s + k)) AS t(p) GROUP BY r),
nearby AS (SELECT r, count(*) AS n_near FROM (SELECT * FROM close EXCEPT SELECT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near_items
FROM d LEFT JOIN found USING (r) LEFT JOIN covered USING (r) LEFT JOIN nearby USING (r)
"""

_TERMS = rf"unnest(regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"

OP12_SQL = f"""
WITH t AS (SELECT doc_id, r, term, count(*) AS tf FROM (SELECT doc_id, r, {_TERMS} AS term FROM (SELECT *, row_number() OVER () AS r FROM documents))
           GROUP BY ALL),
doc AS (SELECT r, sum(tf)::BIGINT AS n FROM t GROUP BY r),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM doc),
term AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, total GROUP BY term),
part AS (SELECT t.doc_id, t.r, t.term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // l))) AS score
         FROM t JOIN doc USING (r) JOIN term USING (term), total),
item AS (SELECT item_id, i, {_TERMS} AS term FROM (SELECT *, row_number() OVER () AS i FROM benchmark)),
scored AS (SELECT item_id, i, doc_id, r, sum(score)::BIGINT AS score FROM item JOIN part USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER g AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW g AS (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) QUALIFY rank <= 20
"""


def _field(name: str) -> str:
    text = f"CAST({name} AS VARCHAR)"
    return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


# CRC-32 is not among DuckDB's functions: bit by bit over the digits, from its polynomial
_CRC32 = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [1::BIGINT, 1, 1, 1, 1, 1, 1, 1]),
                          lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))"""

OP13_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
         {_leaf("CASE WHEN crc % 7 = 0 THEN n_chars::HUGEINT + 1 ELSE n_chars END")} AS claimed
  FROM (SELECT *, xor({_CRC32}, 4294967295) AS crc FROM documents)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree FROM leaves
), levels AS (
  SELECT tree, 0 AS level, pos, leaf AS hash, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)), max((n + 1) // 2)
  FROM levels WHERE n > 1 GROUP BY tree, level, pos // 2
), subroots AS (SELECT tree, hash AS subroot FROM levels WHERE n = 1),
upper AS (
  SELECT 0 AS level, tree - 1 AS pos, subroot AS hash, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)), max((n + 1) // 2)
  FROM upper WHERE n > 1 GROUP BY level, pos // 2
), nodes AS (
  SELECT tree, level, pos, hash FROM levels WHERE n > 1
  UNION ALL SELECT 0, level, pos, hash FROM upper WHERE n > 1
), starts AS (
  SELECT *, (SELECT max(level) FROM levels l WHERE l.tree = placed.tree) AS depth FROM placed
), climb AS (
  SELECT tree AS of, pos AS leaf_pos, tree, depth, 0 AS level, pos, claimed AS folded, '' AS proof FROM starts
  UNION ALL
  SELECT c.of, c.leaf_pos, up.tree, c.depth, up.level, up.pos,
         CASE WHEN c.level = c.depth AND c.tree > 0 THEN c.folded
              WHEN c.pos % 2 = 1 THEN sha256(s.hash || c.folded) ELSE sha256(c.folded || coalesce(s.hash, '')) END,
         CASE WHEN c.level = c.depth AND c.tree > 0 THEN c.proof ELSE c.proof || coalesce(s.hash, '') END
  FROM climb c
  LEFT JOIN nodes s ON s.tree = c.tree AND s.level = c.level AND s.pos = xor(c.pos, 1),
  LATERAL (SELECT CASE WHEN c.level = c.depth AND c.tree > 0 THEN 0 ELSE c.tree END AS tree,
                  CASE WHEN c.level = c.depth AND c.tree > 0 THEN 0 ELSE c.level + 1 END AS level,
                  CASE WHEN c.level = c.depth AND c.tree > 0 THEN c.tree - 1 ELSE c.pos // 2 END AS pos) up
  WHERE c.tree > 0 OR c.level < (SELECT max(level) FROM upper)
)
SELECT p.doc_id, p.leaf, r.subroot, u.hash AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root,
       c.folded = u.hash AS verified
FROM placed p JOIN subroots r USING (tree)
JOIN climb c ON c.of = p.tree AND c.leaf_pos = p.pos AND c.tree = 0 AND c.level = (SELECT max(level) FROM upper)
JOIN upper u ON u.n = 1
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_simple8b": op2_simple8b,
        "op3_ann_tree": op3_ann_tree,
        "op4_toxicity": op4_toxicity,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_ngram_join": op8_ngram_join,
        "op9_secret_scan": op9_secret_scan,
        "op10_quality": op10_quality,
        "op11_decontaminate": op11_decontaminate,
        "op12_dual_tree": op12_dual_tree,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_exact_dedup": OP6_SQL,
        "op11_decontaminate": OP11_SQL,
        "op12_dual_tree": OP12_SQL,
        "op13_merkle_manifest": OP13_SQL,
    }
