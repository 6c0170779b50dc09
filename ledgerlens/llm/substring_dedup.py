"""Substring dedup with a count-min prefilter.

A window is `width` consecutive words of one document. The first pass counts all windows in
a count-min sketch. The second pass groups exactly, by a 96-bit hash, only the windows that
the sketch takes to repeat (it overestimates, so none is lost) and finds, for each, the
smallest document that has it. Words that a window covers in any other document go.

The 96 bits of a window come from two independent hashes of its words (`Words.hash_pair`).

In the second pass a task first settles the windows that repeat among its own documents, and
sends only those of its smallest document on; so a window that a third of all documents share
arrives once a task. Windows travel as packed arrays, dealt to buckets by hash, whose number
follows the input; decisions travel to buckets of documents, where they become ranges of
covered words; a join brings each document its ranges.

Defined results: a null text has no words; a document with fewer words than a window stays
whole; rows with a null identifier stay whole and remove nothing; rows that repeat an
identifier are judged alike, and do not remove each other's words; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .tables import power_of_two, small_batches, text_bytes
from .words import Words, run_hash, slices

#: Windows that a task holds before it sends them, windows of a bucket, and text bytes of the
#: documents whose decisions meet in a bucket.
HELD = 1 << 19
BUCKET_WINDOWS = 8 << 20
BUCKET_BYTES = 16 << 20


class Marks:
    """Windows (or decisions on them) as arrays: document, 32-bit hash of its text (to tell rows of
    one identifier apart), first word, and for windows still to be decided their 96-bit hash."""

    FIELDS = ("doc", "text", "pos", "key", "tag")

    def __init__(self, doc, text, pos, key=None, tag=None):
        self.doc, self.text, self.pos, self.key, self.tag = doc, text, pos, key, tag

    def __len__(self) -> int:
        return len(self.doc)

    def take(self, where) -> Marks:
        return Marks(*(None if x is None else x[where] for x in (getattr(self, f) for f in self.FIELDS)))

    def decided(self) -> Marks:
        return Marks(self.doc, self.text, self.pos)

    def home(self, buckets: int) -> np.ndarray:
        """The bucket of each mark's document, as `dedup_substrings` deals the documents."""
        return ((self.doc ^ self.text) % buckets).astype(np.int32)

    @staticmethod
    def join(parts: list[Marks]) -> Marks:
        return Marks(*(None if getattr(parts[0], f) is None else np.concatenate([getattr(p, f) for p in parts])
                       for f in Marks.FIELDS))

    def pack(self) -> bytes:
        """Runs of one document are stored once; positions as steps in planes of bytes, as most steps are short."""
        n = len(self)
        begins = starts_of_runs(self.doc, self.text)
        step = np.diff(self.pos, prepend=0)
        step[begins] = self.pos[begins]
        step &= 0xFFFFFFFF  # steps back wrap round
        parts = [np.asarray([n, len(begins), self.key is not None], "<i8"),
                 self.doc[begins].astype("<i8"), self.text[begins].astype("<i4"),
                 np.diff(np.append(begins, n)).astype("<u4"),
                 (step & 0xFF).astype("u1"), (step >> 8 & 0xFF).astype("u1"), (step >> 16).astype("<u2")]
        if self.key is not None:
            parts += [self.key.astype("<u8"), self.tag.astype("<u4")]
        return b"".join(p.tobytes() for p in parts)

    @staticmethod
    def unpack(data: bytes) -> Marks:
        n, docs, keyed = (int(x) for x in np.frombuffer(data, "<i8", 3))
        at = 24

        def read(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        doc, text, runs = read("<i8", docs), read("<i4", docs).astype(np.int64), read("<u4", docs)
        step = read("u1", n).astype(np.int64)
        step |= read("u1", n).astype(np.int64) << 8
        step |= read("<u2", n).astype(np.int64) << 16
        begins, total = np.cumsum(runs) - runs, np.cumsum(step)
        pos = (total - np.repeat(total[begins] - step[begins], runs)) & 0xFFFFFFFF
        out = Marks(np.repeat(doc, runs), np.repeat(text, runs), pos)
        if keyed:
            out.key, out.tag = read("<u8", n), read("<u4", n)
        return out

    def later(self) -> np.ndarray:
        """Whether a smaller document has the same window."""
        order = np.lexsort((self.doc, self.tag, self.key))
        doc = self.doc[order]
        begins = starts_of_runs(self.key[order], self.tag[order])
        least = np.repeat(doc[begins], np.diff(np.append(begins, len(doc))))
        out = np.zeros(len(order), dtype=bool)
        out[order] = doc > least
        return out

    def dealt(self, bucket: np.ndarray) -> Iterator[tuple[int, Marks]]:
        """The marks of each bucket, in their order."""
        order = np.argsort(bucket, kind="stable")
        marks, bucket = self.take(order), bucket[order]
        begins = starts_of_runs(bucket)
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(bucket)], strict=False):
            yield int(bucket[a]), marks.take(slice(a, b))


def starts_of_runs(*columns: np.ndarray) -> np.ndarray:
    """Where a run of rows that are equal in all columns begins."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def dedup_substrings(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: identifier, n_words, n_removed, kept_text (its kept words, joined by
    one space). The identifier must be an integer."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    total = text_bytes(rows)
    expected = total / 6
    doc_buckets = power_of_two(total / BUCKET_BYTES, 16, 1 << 30)
    buckets = power_of_two(expected / BUCKET_WINDOWS, 16, 1 << 30)
    rows = rows.withColumn("text_hash", F.hash("text").cast("long"))
    def window_hashes(column: pa.Array) -> np.ndarray:
        words = Words(column)
        return words.windows(words.hashes(), width)[1]

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(sketch.build(rows.select("text"), window_hashes, expected))

    def sent(kind: str, marks: Marks, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
        dealt = list(marks.dealt(bucket))
        yield pa.RecordBatch.from_arrays(
            [pa.array([kind] * len(dealt), pa.string()), pa.array([b for b, _ in dealt], pa.int32()),
             pa.array([m.pack() for _, m in dealt], pa.binary())], names=["kind", "bucket", "marks"])

    def settle(held: list[Marks]) -> Iterator[pa.RecordBatch]:
        """Decides what the task's own documents decide, and sends the rest on."""
        marks = Marks.join(held)
        later = marks.later()
        open_, gone = marks.take(~later), marks.take(later).decided()
        yield from sent("open", open_, ((open_.key >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32))
        yield from sent("gone", gone, gone.home(doc_buckets))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = shared.value
        held, n = [], 0
        for batch in batches:
            known = batch.column("id").is_valid().to_numpy(zero_copy_only=False)
            doc = batch.column("id").fill_null(0).to_numpy()
            text = batch.column("text_hash").to_numpy()
            for a, b in slices(batch.column("text")):
                words = Words(batch.column("text").slice(a, b - a))
                hashes, others = words.hash_pair()
                first, key = words.windows(hashes, width)
                may = repeated(key) & known[a:b][words.text[first]]
                first, key = first[may], key[may]
                tag = (run_hash(others, first, first + width, 1) >> np.uint64(32)).astype(np.uint32)
                at = words.text[first]
                held.append(Marks(doc[a:b][at], text[a:b][at], first - words.word_offset[at], key, tag))
                n += len(first)
                if n >= HELD:
                    yield from settle(held)
                    held, n = [], 0
        if n:
            yield from settle(held)

    def resolve(key: tuple, table: pa.Table) -> pa.Table:
        """Decides the open windows of one bucket; decisions that tasks made pass through."""
        if key[0].as_py() == "gone":
            return table.select(["bucket", "marks"])
        marks = Marks.join([Marks.unpack(x) for x in table.column("marks").to_pylist()])
        marks = marks.take(marks.later()).decided()
        dealt = [(b, m.take(np.lexsort((m.pos, m.text, m.doc)))) for b, m in marks.dealt(marks.home(doc_buckets))]
        return pa.table({"bucket": pa.array([b for b, _ in dealt], pa.int32()),
                         "marks": pa.array([m.pack() for _, m in dealt], pa.binary())})

    def covered(key: tuple, table: pa.Table) -> pa.Table:
        """What the marks of one bucket's documents cover: word ranges [start, end), one row a document."""
        marks = Marks.join([Marks.unpack(x) for x in table.column("marks").to_pylist()])
        marks = marks.take(np.lexsort((marks.pos, marks.text, marks.doc)))
        new_doc = np.zeros(len(marks), dtype=bool)
        new_doc[starts_of_runs(marks.doc, marks.text)] = True
        new = new_doc.copy()
        new[1:] |= marks.pos[1:] > marks.pos[:-1] + width
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(marks)) - 1
        spans = np.stack([marks.pos[first], marks.pos[last] + width], axis=1).ravel()
        begins = np.flatnonzero(new_doc[first])
        edges = np.append(begins, len(first)) * 2
        return pa.table({"doc": pa.array(marks.doc[first[begins]], pa.int64()), "doc_text": pa.array(marks.text[first[begins]], pa.int64()),
                         "spans": pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(spans.astype(np.int32)))})

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Takes the covered words out of each document, slice by slice."""
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                n_words, n_removed, kept = [], [], []
                for text, spans in zip(part.column("text").cast(pa.large_binary()).to_pylist(), part.column("spans").to_pylist(), strict=True):
                    words = text.split()  # at space and 0x09-0x0D
                    n_words.append(len(words))
                    if spans:
                        edges = [0, *spans, len(words)]
                        words = [w for i in range(0, len(edges), 2) for w in words[edges[i]:edges[i + 1]]]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                     pa.array(kept, pa.large_binary()).cast(pa.large_string()).cast(pa.string())],
                    names=["id", "n_words", "n_removed", "kept_text"])

    marks = (small_batches(rows).mapInArrow(candidates, "kind string, bucket int, marks binary").groupBy("kind", "bucket")
             .applyInArrow(resolve, "bucket int, marks binary"))
    spans = marks.groupBy("bucket").applyInArrow(covered, "doc long, doc_text long, spans array<int>")
    # a join, not a group: rows that repeat a document, however many, stream past its ranges; a null identifier has none
    found = rows.join(spans, (F.col("id") == F.col("doc")) & (F.col("text_hash") == F.col("doc_text")), "left")
    out = found.select("id", "text", "spans").mapInArrow(finish, "id long, n_words long, n_removed long, kept_text string")
    return out.withColumnRenamed("id", id_col)
