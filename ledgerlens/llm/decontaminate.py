"""Benchmark decontamination on a distributed positional inverted index of the training texts.

Index: every task cuts its documents into segments of bounded size and stores, for each segment and
term, where the term stands: the positions of all its occurrences as gaps of one to five bytes.
Documents of a segment are laid side by side with one empty position between them; a header row
of the segment holds their identifiers and sizes. The index covers every word of every document,
is written once, and serves any number of test sets.

Search: the windows of the test items (every run of `width` words; the whole item if it is
shorter) come in blocks of bounded size. The postings of a block's terms meet segment by
segment. There the lists of a window, shifted by their terms' offsets, are intersected from the rarest
term on, for all windows at once; what is left are exact phrases. For proximity, the lists are
intersected within a span of `width` + `slop` positions instead, in any order.

Defined results: words are the maximal runs of digits, letters a-z and characters outside ASCII
after A-Z is lower-cased; a null or empty text has none; a text of any length is indexed whole, in a
segment of its own if it is longer than one; rows that repeat an identifier are documents of their
own; items without words or without an identifier match nothing, and items that repeat an identifier
count as one; empty tables give no matches; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import BATCH_ROWS, session_settings, written
from .words import NOT_ALPHANUMERIC, Words, slices

#: Text bytes of a segment of the index (a longer text makes a longer one), and of the test items in a block.
SEGMENT_BYTES = 8 << 20
BLOCK_BYTES = 1 << 20
#: Candidates that a segment's search holds at a time.
HELD = 1 << 21

INDEX = "segment long, term string, n long, postings binary, ids array<long>, sizes array<int>"
MATCHES = "segment long, row int, item_id long, kind string, first int, last int"

#: A posting key is term << _POSITION | position.
_POSITION = 40


def pack(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, length of each number): seven bits a byte, low ones first, the last byte below 128."""
    size = np.ones(len(numbers), dtype=np.int64)
    for bits in range(7, 35, 7):
        size += numbers >> bits > 0
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, dtype=np.uint8)
    for k in range(5):
        has = size > k
        out[(end - size)[has] + k] = (numbers[has] >> (7 * k) & 127) | np.where(size[has] > k + 1, 128, 0)
    return out, size


def unpack(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1]).astype(np.int64)
    place = np.arange(len(data)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), first) if len(data) else np.zeros(0, np.int64)


def build_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The positional index of all texts, written under the checkpoint folder."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    schema = pa.schema([("segment", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("postings", pa.binary()),
                        ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))])

    def segment(number: int, ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        words = Words(texts, lower=True, between=NOT_ALPHANUMERIC)
        one = pa.array([None])
        yield pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), one.cast(pa.string()), pa.array([len(texts)], pa.int64()), one.cast(pa.binary()),
             pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
             pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(words.count.astype(np.int32)))], schema=schema)
        if not len(words.start):
            return
        terms = words.terms()
        code = terms.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        position = (np.arange(len(code)) + words.text)[order]
        n = np.bincount(code, minlength=len(terms.dictionary))
        begins = np.cumsum(n) - n
        gaps = np.diff(position, prepend=0)
        gaps[begins] = position[begins]
        data, size = pack(gaps)
        edges = np.concatenate([[0], np.add.reduceat(size, begins).cumsum()]).astype(np.int64)
        postings = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(edges), pa.py_buffer(data)])
        step = max(1, BATCH_ROWS * 16)
        for a in range(0, len(n), step):
            m = min(step, len(n) - a)
            nothing = pa.nulls(m)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, number)), terms.dictionary.slice(a, m).cast(pa.string()), pa.array(n[a:a + m]),
                 postings.slice(a, m).cast(pa.binary()), nothing.cast(pa.list_(pa.int64())), nothing.cast(pa.list_(pa.int32()))],
                schema=schema)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            column = batch.column("text")
            for a, b in slices(column, SEGMENT_BYTES):
                part = batch.slice(a, b - a)
                more = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                if held and size + more > SEGMENT_BYTES:
                    yield from segment(number, *joined(held))
                    number, held, size = number + 1, [], 0
                held.append(part)
                size += more
        if held:
            yield from segment(number, *joined(held))

    def joined(parts: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
        return (pa.concat_arrays([p.column("id") for p in parts]),
                pa.concat_arrays([p.column("text").cast(pa.large_string()) for p in parts]))

    with session_settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)}):
        return written(rows.mapInArrow(index, INDEX), "positional-index")


def documents_of(index: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a document: segment, row (its place there), its identifier and n_words."""
    return (index.where("term IS NULL").select("segment", F.posexplode(F.arrays_zip("ids", "sizes")).alias("row", "d"))
            .select("segment", "row", F.col("d.ids").alias(id_col), F.col("d.sizes").cast("long").alias("n_words")))


class Block:
    """Windows of some test items as rows of term numbers (-1 beyond the end of a short one)."""

    def __init__(self, items: list[tuple[int, str]], width: int):
        words = Words(pa.array([t for _, t in items], pa.string()), lower=True, between=NOT_ALPHANUMERIC)
        terms = words.terms()
        self.terms = terms.dictionary.to_pylist()
        code = terms.indices.to_numpy().astype(np.int64)
        self.item, windows = [], []
        for i, (item_id, _) in enumerate(items):
            own = code[words.word_offset[i]:words.word_offset[i + 1]]
            if len(own):
                own = np.concatenate([own, np.full(max(0, width - len(own)), -1)])
                windows.append(np.lib.stride_tricks.sliding_window_view(own, width))
                self.item += [item_id] * len(windows[-1])
        self.windows = np.concatenate(windows) if windows else np.zeros((0, width), np.int64)
        self.item = np.asarray(self.item, dtype=np.int64)


def blocks_of(items: DataFrame, item_col: str, text: str, width: int) -> Iterator[Block]:
    """The test items in blocks of at most BLOCK_BYTES bytes of text (one item at least)."""
    rows = items.select(F.col(item_col).cast("long"), F.col(text).cast("string")).where(
        F.col(item_col).isNotNull() & (F.octet_length(text) > 0))
    held, size = [], 0
    for item_id, item in rows.toLocalIterator():
        more = len(item.encode())
        if held and size + more > BLOCK_BYTES:
            yield Block(held, width)
            held, size = [], 0
        held.append((item_id, item))
        size += more
    if held:
        yield Block(held, width)


class Postings:
    """The postings of one segment as sorted keys."""

    def __init__(self, term: np.ndarray, n: np.ndarray, data: np.ndarray, n_terms: int):
        gaps = unpack(data)
        begins = np.cumsum(n) - n
        total = np.cumsum(gaps)
        before = np.repeat(total[begins] - gaps[begins], n)
        self.keys = np.sort(np.repeat(term, n) << _POSITION | (total - before))
        self.count = np.bincount(term, weights=n, minlength=n_terms + 1).astype(np.int64)  # one more for -1
        self.begin = np.searchsorted(self.keys, np.arange(n_terms + 1) << _POSITION)

    def candidates(self, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For the windows whose terms all occur, in chunks: (window, order of its words from the rarest on,
        position of each occurrence of the rarest)."""
        count = np.where(windows < 0, np.iinfo(np.int64).max, self.count[windows])
        live = np.flatnonzero((count > 0).all(axis=1))
        order = np.argsort(count[live], axis=1, kind="stable")
        least = count[live, order[:, 0]]
        total, a = np.cumsum(least), 0
        while a < len(live):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + HELD, side="right")))
            rarest = windows[live[a:b], order[a:b, 0]]
            each = least[a:b]
            at = np.repeat(self.begin[rarest] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            yield np.repeat(live[a:b], each), np.repeat(order[a:b], each, axis=0), self.keys[at] & ((1 << _POSITION) - 1)
            a = b

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first position) of every exact occurrence."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for window, order, position in self.candidates(windows):
            first = position - order[:, 0]
            keep = first >= 0
            for r in range(windows.shape[1]):
                window, order, first = window[keep], order[keep], first[keep]
                if r + 1 == windows.shape[1]:
                    break
                term = windows[window, order[:, r + 1]]
                key = term << _POSITION | (first + order[:, r + 1])
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                keep = (term < 0) | (self.keys[at] == key)
            found.append((window, first))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _next(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """The term's first position from `position` on (a far one if there is none)."""
        at = np.searchsorted(self.keys, term << _POSITION | np.maximum(position, 0))
        key = self.keys[np.minimum(at, len(self.keys) - 1)]
        return np.where((at < len(self.keys)) & (key >> _POSITION == term), key & ((1 << _POSITION) - 1), 1 << _POSITION)

    def near(self, windows: np.ndarray, slop: int, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, first, last position) of spans of at most its length + slop positions of one document that hold
        all words of the window, in any order; one span, the shortest, around each occurrence of its rarest word.
        `begins`: the first position of each document."""
        far = 1 << _POSITION
        found = [(np.zeros(0, np.int64),) * 3]
        for window, order, position in self.candidates(windows):
            row = np.searchsorted(begins, position, side="right")
            low, high = begins[row - 1], np.append(begins, far)[row]
            span = (windows >= 0).sum(axis=1)[window] + slop
            for r in range(1, windows.shape[1]):
                term = windows[window, order[:, r]]
                at = self._next(np.maximum(term, 0), np.maximum(position - span + 1, low))
                keep = (term < 0) | (at < np.minimum(position + span, high))
                window, order, position, span, low, high = (x[keep] for x in (window, order, position, span, low, high))
            best = np.full_like(position, far)
            best_first, best_last = np.zeros_like(position), np.zeros_like(position)
            for back in range(windows.shape[1] + slop):
                start = position - back
                first, last = np.full_like(position, far), np.zeros_like(position)
                for j in range(windows.shape[1]):
                    term = windows[window, j]
                    at = self._next(np.maximum(term, 0), start)
                    first = np.where(term < 0, first, np.minimum(first, at))
                    last = np.where(term < 0, last, np.maximum(last, at))
                better = (start >= low) & (last < high) & (last - first < np.minimum(span, best))
                best = np.where(better, last - first, best)
                best_first, best_last = np.where(better, first, best_first), np.where(better, last, best_last)
            good = best < far
            found.append((window[good], best_first[good], best_last[good]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def merged(row: np.ndarray, item: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of one (row, item) that overlap or touch, as one."""
    order = np.lexsort((first, item, row))
    row, item, first, last = row[order], item[order], first[order], last[order]
    if not len(row):
        return row, item, first, last
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
    lift = np.cumsum(new) * (1 << 32)  # the furthest end so far inside its run
    reach = np.maximum.accumulate(last + lift) - lift
    new[1:] |= first[1:] > reach[:-1] + 1
    begins = np.flatnonzero(new)
    return row[begins], item[begins], first[begins], np.maximum.reduceat(last, begins)


def matches(index: DataFrame, items: DataFrame, width: int, slop: int | None = None, item_col: str = "item_id",
            text: str = "text") -> DataFrame:
    """Spans of documents that match test items: segment, row, item_id, kind, first, last (word numbers from 0).

    kind `phrase`: covered by exact occurrences of the item's windows, merged. kind `near` (only with `slop`):
    holds all words of a window within `slop` positions more than it has, merged."""
    spark = index.sparkSession
    parts = []
    for block in blocks_of(items, item_col, text, width):
        shared = spark.sparkContext.broadcast((block.windows, block.item, len(block.terms)))  # BLOCK_BYTES of text
        vocabulary = spark.createDataFrame(list(zip(block.terms, range(len(block.terms)), strict=True)), "term string, number long")

        lists = index.where("term IS NOT NULL").join(F.broadcast(vocabulary), "term").select("segment", "number", "n", "postings", "sizes")
        heads = index.where("term IS NULL").select("segment", F.lit(-1).cast("long").alias("number"), "n", "postings", "sizes")
        parts.append(lists.unionByName(heads).groupBy("segment").applyInArrow(_search(shared, slop), MATCHES))
    out = parts[0] if parts else spark.createDataFrame([], MATCHES)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _search(shared, slop: int | None):
    """Searches one segment for the windows of one block."""
    def search(key: tuple, table: pa.Table) -> pa.Table:
        windows, item_of, n_terms = shared.value
        table = table.combine_chunks()
        number = table.column("number").to_numpy()
        head = table.filter(pc.equal(table.column("number"), -1)).column("sizes")[0].values.to_numpy()
        begins = np.cumsum(head + 1) - (head + 1)  # of each document
        lists = table.filter(pc.greater_equal(table.column("number"), 0))
        rows = [(np.zeros(0, np.int64),) * 4] * 2
        if len(lists):
            data = np.frombuffer(b"".join(lists.column("postings").to_pylist()), dtype=np.uint8)
            postings = Postings(number[number >= 0], lists.column("n").to_numpy(), data, n_terms)
            window, first = postings.phrases(windows)
            rows[0] = spans(window, first, first + (windows >= 0).sum(axis=1)[window] - 1, item_of, begins)
            if slop is not None:
                rows[1] = spans(*postings.near(windows, slop, begins), item_of, begins)
        row, item, first, last = (np.concatenate(x) for x in zip(*rows, strict=True))
        kind = ["phrase"] * len(rows[0][0]) + ["near"] * len(rows[1][0])
        return pa.table({"segment": pa.array([key[0].as_py()] * len(row), pa.int64()), "row": pa.array(row, pa.int32()),
                         "item_id": pa.array(item, pa.int64()), "kind": pa.array(kind, pa.string()),
                         "first": pa.array(first, pa.int32()), "last": pa.array(last, pa.int32())})
    return search


def spans(window: np.ndarray, first: np.ndarray, last: np.ndarray, item_of: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, item, first, last) inside the documents; spans that leave a document are none."""
    row = np.searchsorted(begins, first, side="right") - 1
    inside = row == np.searchsorted(begins, last, side="right") - 1
    row, first, last = row[inside], first[inside], last[inside]
    return merged(row, item_of[window[inside]], first - begins[row], last - begins[row])


def contamination(docs: DataFrame, items: DataFrame, width: int, slop: int | None = None) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit (words inside phrases), items (identifiers of the items with
    phrases there, sorted as strings) and near_items (those with a near span but no phrase)."""
    index = build_index(docs)
    found = written(matches(index, items, width, slop), "benchmark-matches")
    where = ["segment", "row"]
    reached = F.max("last").over(Window.partitionBy(*where).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1))
    hit = (found.where("kind = 'phrase'").withColumn("begin", F.greatest("first", F.coalesce(reached + 1, F.lit(0))))
           .groupBy(*where).agg(F.sum(F.greatest(F.lit(0), F.col("last") - F.col("begin") + 1)).alias("n_hit")))

    def named(kind: str):
        return F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("item_id").cast("string"))))
    listed = found.groupBy(*where).agg(named("phrase").alias("items"), named("near").alias("near"))
    none = F.array().cast("array<string>")
    return (documents_of(index).join(hit, where, "left").join(listed, where, "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"),
                    F.coalesce(F.array_except("near", "items"), none).alias("near_items")))
