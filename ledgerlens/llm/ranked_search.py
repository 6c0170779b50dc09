"""Ranked lexical search of many items at once by a dual-tree search.

A document's weight for a term grows with the term's occurrences in it and falls with its length;
an item's weight for a term grows with the term's rarity; a score is the product of the two vectors.
All of it is integer arithmetic.

Documents become vectors over the terms of the items (items come in blocks of bounded size), which are
written once a block. Every task puts its documents into trees, neighbours by their weightiest
term, and the items into another; a node holds, coordinate by coordinate, the largest weights below
it. The product of two nodes so bounds every score between them. A pair of nodes is left out as a
whole if its bound is below the weakest kth score that the item node's items have so far; otherwise
their children are paired, the most promising documents first. What is left is scored
exactly, so nothing that belongs into a result is lost.

The kth scores that a task starts from come from a first search of one document in FLOOR (by hash):
real scores, so at most too low, which costs time and no result. Tasks send their k best an item.

Defined results: terms are the maximal runs of ASCII letters and digits and characters outside ASCII,
A-Z lower-cased; null and empty texts have none and are in no result; texts of any length are read
whole; equal scores go by ascending identifier, null last; rows that repeat an identifier are
documents, or items, of their own; an item without terms, or without a document that shares one, has no
rows; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import BATCH_ROWS, session_settings, written
from .words import NOT_ALPHANUMERIC, Words, slices

#: Text bytes of the items in a block (one item at least).
BLOCK_BYTES = 64 << 10
#: Cells of a matrix over documents (or nodes) and terms, and the documents of a tree: most and least.
CELLS = 8 << 20
TREE_DOCS = (64, 2048)
#: Documents and items of a lowest node, children of a higher one, documents scored before bounds are taken anew.
LEAF_DOCS, LEAF_ITEMS, FAN, STEP_DOCS = 8, 4, 4, 256
#: The first search reads one document in so many.
FLOOR = 16

VECTORS = "id long, n long, terms array<int>, counts array<int>"
FOUND = "item int, id long, score long"
#: Products are exact in doubles below this.
_EXACT = 1 << 53


def term_weight(n_docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


def document_weight(count: np.ndarray, length: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    m = 100 - 25 + (25 * length * n_docs) // total
    return (1_000_000_000 * count) // (1000 * count + 12 * m)


class Block:
    """Some items: their identifiers, terms, and counts of each (CSR)."""

    def __init__(self, items: list[tuple[int, str]]):
        words = Words(pa.array([t for _, t in items], pa.string()), lower=True, between=NOT_ALPHANUMERIC)
        terms = words.terms()
        self.ids = [i for i, _ in items]
        self.terms = terms.dictionary.to_pylist()
        pairs, self.counts = np.unique(words.text << 32 | terms.indices.to_numpy().astype(np.int64), return_counts=True)
        self.item, self.term = pairs >> 32, pairs & 0xFFFFFFFF


def blocks_of(items: DataFrame, item_col: str, text: str) -> Iterator[Block]:
    rows = items.select(F.col(item_col).cast("long"), F.col(text).cast("string")).where(F.octet_length(text) > 0)
    held, size = [], 0
    for item_id, item in rows.toLocalIterator():
        more = len(item.encode())
        if held and size + more > BLOCK_BYTES:
            yield Block(held)
            held, size = [], 0
        held.append((item_id, item))
        size += more
    if held:
        yield Block(held)


def vectors(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, n (its terms with repeats), and how often it holds which of `terms`; written."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(shared.value, pa.large_string())
        for batch in batches:
            for a, b in slices(batch.column("text")):
                words = Words(batch.column("text").slice(a, b - a), lower=True, between=NOT_ALPHANUMERIC)
                found = words.terms()
                number = pc.fill_null(pc.index_in(found.dictionary, wanted), -1).to_numpy()[found.indices.to_numpy()].astype(np.int64)
                pairs, n = np.unique((words.text << 32 | number)[number >= 0], return_counts=True)
                edges = pa.array(np.searchsorted(pairs >> 32, np.arange(words.n_texts + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array(words.count.astype(np.int64)),
                     pa.ListArray.from_arrays(edges, pa.array((pairs & 0xFFFFFFFF).astype(np.int32))),
                     pa.ListArray.from_arrays(edges, pa.array(n.astype(np.int32)))], names=["id", "n", "terms", "counts"])

    with session_settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)}):
        return written(rows.mapInArrow(count, VECTORS), "term-vectors")


def holders(rows: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each term."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(total[term])], names=["term", "n"])
    out = np.zeros(n_terms, dtype=np.int64)
    for term, n in rows.select("terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        out[term] = n  # one row a term of the block
    return out


class Tree:
    """Rows of a matrix as leaves in the order of their largest weights, with maxima level by level (top first)."""

    def __init__(self, rows: np.ndarray, importance: np.ndarray, leaf: int):
        weight = rows * importance
        second = np.argsort(-weight, axis=1, kind="stable")[:, :2] if rows.shape[1] > 1 else np.zeros((len(rows), 2), int)
        self.order = np.lexsort((second[:, 1], second[:, 0]))
        self.rows = rows[self.order]
        level = np.maximum.reduceat(self.rows, np.arange(0, len(rows), leaf))
        self.leaf, self.levels = leaf, [level]
        while len(level) > 1:
            level = np.maximum.reduceat(level, np.arange(0, len(level), FAN))
            self.levels.insert(0, level)


class Best:
    """The k best documents of each item so far."""

    def __init__(self, n_items: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.score = np.zeros((n_items, k), dtype=np.int64)
        self.id = np.full((n_items, k), np.iinfo(np.int64).max)
        self.null = np.ones((n_items, k), dtype=bool)

    def least(self) -> np.ndarray:
        """A score below this is in no item's result; every score in one is above 0."""
        return np.maximum(np.maximum(self.floor, self.score[:, -1]), 1)

    def add(self, items: np.ndarray, score: np.ndarray, id_: np.ndarray, null: np.ndarray) -> None:
        """`score`: items x documents, 0 where there is nothing to add."""
        may = (score >= self.least()[items][:, None]).any(axis=1)
        items, score = items[may], score[may]
        if not len(items):
            return
        score = np.concatenate([self.score[items], score], axis=1)
        id_ = np.concatenate([self.id[items], np.broadcast_to(id_, (len(items), len(id_)))], axis=1)
        null = np.concatenate([self.null[items], np.broadcast_to(null, (len(items), len(null)))], axis=1)
        order = np.lexsort((id_, null, -score), axis=-1)[:, :self.k]
        for name, values in (("score", score), ("id", id_), ("null", null)):
            getattr(self, name)[items] = np.take_along_axis(values, order, axis=1)


def search(items: Tree, docs: Tree, best: Best, id_: np.ndarray, null: np.ndarray) -> int:
    """Adds to `best` what the documents of one tree give; how many (item, document) pairs were scored."""
    def weakest(n_nodes: int) -> np.ndarray:
        least = best.least()[items.order]
        while len(least) > n_nodes:
            least = np.minimum.reduceat(least, np.arange(0, len(least), items.leaf if len(least) == len(items.order) else FAN))
        return least

    live = np.ones((1, 1), dtype=bool)
    for step in range(max(len(items.levels), len(docs.levels))):
        upper_items, upper_docs = (t.levels[min(step, len(t.levels) - 1)] for t in (items, docs))
        if len(upper_items) > live.shape[0]:
            live = np.repeat(live, FAN, axis=0)[:len(upper_items)]
        if len(upper_docs) > live.shape[1]:
            live = np.repeat(live, FAN, axis=1)[:, :len(upper_docs)]
        bound = np.zeros(live.shape, dtype=items.rows.dtype)
        some_items, some_docs = np.flatnonzero(live.any(axis=1)), np.flatnonzero(live.any(axis=0))
        if not len(some_items):
            return 0
        bound[np.ix_(some_items, some_docs)] = upper_items[some_items] @ upper_docs[some_docs].T
        live &= bound >= weakest(len(upper_items))[:, None]
    scored = 0
    promising = np.argsort(-np.where(live, bound, 0).max(axis=0), kind="stable")
    promising = promising[live[:, promising].any(axis=0)]
    for a in range(0, len(promising), STEP_DOCS // docs.leaf):
        nodes = promising[a:a + STEP_DOCS // docs.leaf]
        pairs = live[:, nodes] & (bound[:, nodes] >= weakest(live.shape[0])[:, None])
        nodes, pairs = nodes[pairs.any(axis=0)], pairs[:, pairs.any(axis=0)]
        if not len(nodes):
            continue
        doc = (nodes[:, None] * docs.leaf + np.arange(docs.leaf)).ravel()
        doc_pairs = np.repeat(pairs, docs.leaf, axis=1)[:, doc < len(docs.rows)]
        doc = doc[doc < len(docs.rows)]
        item_pairs = np.repeat(doc_pairs, items.leaf, axis=0)[:len(items.order)]
        item = np.flatnonzero(item_pairs.any(axis=1))
        score = (items.rows[item] @ docs.rows[doc].T).astype(np.int64) * item_pairs[item]
        scored += int(item_pairs.sum())
        at = docs.order[doc]
        best.add(items.order[item], score, id_[at], null[at])
    return scored


def best_documents(rows: DataFrame, block: Block, weights: np.ndarray, n_docs: int, total: int, k: int,
                   floor: np.ndarray) -> DataFrame:
    """item (its number in the block), id, score of the k best documents of each task."""
    size = int(np.clip(CELLS // max(len(block.terms), 1), *TREE_DOCS))
    most = np.bincount(block.item, weights=block.counts * weights[block.term] * 1e6)
    exact = np.float64 if most.max(initial=0) < _EXACT else np.int64
    shared = rows.sparkSession.sparkContext.broadcast((block.item, block.term, block.counts * weights[block.term], floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, term, weight, least = shared.value
        matrix = np.zeros((len(least), len(weights)), dtype=exact)
        matrix[item, term] = weight
        tree, best = Tree(matrix, np.ones(len(weights)), LEAF_ITEMS), Best(len(least), k, least)
        for held in of_size(batches, size):
            length = held.column("n").to_numpy()
            lists = held.column("terms").combine_chunks()
            doc = np.repeat(np.arange(len(held)), pc.list_value_length(lists).to_numpy())
            count = held.column("counts").combine_chunks().flatten().to_numpy().astype(np.int64)
            used, column = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            if not len(used):
                continue
            cells = np.zeros((len(held), len(used)), dtype=exact)
            cells[doc, column] = document_weight(count, length[doc], n_docs, total)
            docs = Tree(cells, weights[used], LEAF_DOCS)
            narrow = Tree.__new__(Tree)  # the items' tree over the terms that these documents hold
            narrow.order, narrow.leaf, narrow.rows = tree.order, tree.leaf, tree.rows[:, used]
            narrow.levels = [level[:, used] for level in tree.levels]
            ids = held.column("id").combine_chunks()
            search(narrow, docs, best, pc.fill_null(ids, np.iinfo(np.int64).max).to_numpy(), pc.is_null(ids).to_numpy(zero_copy_only=False))
        at, place = np.nonzero(best.score >= best.least()[:, None])
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(best.id[at, place], mask=best.null[at, place]),
             pa.array(best.score[at, place])], names=["item", "id", "score"])

    return rows.mapInArrow(run, FOUND)


def of_size(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of `batches`, `size` at a time."""
    held, n = [], 0
    for batch in batches:
        while len(batch):
            part = batch.slice(0, size - n)
            held.append(part)
            n += len(part)
            batch = batch.slice(len(part))
            if n == size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", item_col: str = "item_id",
           text: str = "text") -> DataFrame:
    """item_col, rank (from 1), id_col and score of each item's k highest-scoring documents with a score above 0."""
    spark = docs.sparkSession
    parts = []
    for block in blocks_of(items, item_col, text):
        rows = vectors(docs, block.terms, id_col)
        n_docs, total = rows.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            break
        held = holders(rows, len(block.terms))
        weights = np.asarray([term_weight(n_docs, int(n)) for n in held], dtype=np.int64)
        of_item = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))

        def first(part: DataFrame, floor: np.ndarray, block=block, weights=weights, n=n_docs, t=total, w=of_item) -> DataFrame:
            found = best_documents(part, block, weights, n, t, k, floor)
            return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        floor = np.zeros(len(block.ids), dtype=np.int64)
        for row in first(rows.where(F.xxhash64("id", "n") % FLOOR == 0), floor).where(F.col("rank") == k).collect():
            floor[row["item"]] = row["score"]  # one row an item of the block
        number = spark.createDataFrame(list(enumerate(block.ids)), "item int, item_id long")
        parts.append(first(rows, floor).join(F.broadcast(number), "item")
                     .select(F.col("item_id").alias(item_col), F.col("rank").cast("int").alias("rank"),
                             F.col("id").alias(id_col), "score"))
    if not parts:
        return spark.createDataFrame([], f"{item_col} long, rank int, {id_col} long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
