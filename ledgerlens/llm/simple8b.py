"""Token ids in a Simple-8b word-aligned binary format.

Format. A 64-bit word holds a 4-bit selector in its top bits and 60 bits of ids, the first
id lowest. Selectors 1 to 14 name how many ids of how many bits a word packs (`PACKINGS`).
Selector 15 is the escape: the next 64-bit word is one id as it is, for ids of 2^60 and
more. Selector 0 is not used. Every document starts at a word of its own.

A file holds blocks of consecutive documents in ascending identifier order. A block has the
number of the file's ids before it and of its own, the words (little-endian), and for each document its identifier, number of
ids and the offset of its first word, so that blocks and documents decode alone and whole
blocks decode with array operations. The files are Parquet, written and committed by Spark;
part numbers ascend with the identifiers.

Defined results: a null text counts as empty and has the end id alone; null identifiers come
first; rows that repeat an identifier are all kept, ordered by their text; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import byte_characters
from .tables import shuffle_partitions, written
from .wordwise import PartCache, encode_texts
from .words import ASCII_LOWER, Words, slices, spans

#: Fixed values of the format: selector -> (ids in a word, bits of an id).
PACKINGS = {1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7),
            8: (7, 8), 9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30), 14: (1, 60)}
ESCAPE = 15
#: Text bytes of a block; a longer document has a block of its own.
BLOCK_BYTES = 4 << 20
#: So few documents of a block are packed one by one.
FEW = 32

BLOCKS = ("part int, before long, n_ids long, words binary, "
          "docs array<struct<id: {id}, n: long, word: long>>")


def _runs(flags: np.ndarray, count: int) -> np.ndarray:
    """Whether `count` flags in a row, from each place on, are set."""
    out, have = flags.copy(), 1
    while have < count:
        more = min(have, count - have)
        out[:-more] &= out[more:]
        out[len(out) - more:] = False
        have += more
    return out


def pack(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each document) of consecutive documents' ids (uint64)."""
    n = len(ids)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    left = np.repeat(ends, lengths) - np.arange(n)
    step = np.ones(n, dtype=np.int64)
    selector = np.full(n, 14, dtype=np.uint64)
    selector[ids >> np.uint64(60) != 0] = ESCAPE
    narrow = ids.astype(np.uint32) if n and ids.max() < 1 << 32 else ids
    for s in range(13, 0, -1):
        count, bits = PACKINGS[s]
        small = narrow < 1 << bits
        if np.count_nonzero(small) < count:
            continue
        fits = _runs(small, count) & (left >= count)
        step[fits], selector[fits] = count, s
    begins = np.zeros(n, dtype=bool)  # ids that begin a word
    now, stop = starts[lengths > 0], ends[lengths > 0]
    while len(now) > FEW:  # all documents take a word at a time
        begins[now] = True
        now = now + step[now]
        more = now < stop
        now, stop = now[more], stop[more]
    steps = step.tolist() if len(now) else []
    for i, end in zip(now.tolist(), stop.tolist(), strict=True):
        at = []
        while i < end:
            at.append(i)
            i += steps[i]
        begins[at] = True
    at = np.flatnonzero(begins)
    chosen = selector[at]
    place = np.cumsum(1 + (chosen == ESCAPE)) - 1 - (chosen == ESCAPE)
    words = np.zeros(len(at) + np.count_nonzero(chosen == ESCAPE), dtype=np.uint64)
    words[place] = chosen << np.uint64(60)
    for s, (count, bits) in PACKINGS.items():
        mine = np.flatnonzero(chosen == s)
        if len(mine):
            values = ids[at[mine][:, None] + np.arange(count)] << (np.arange(count, dtype=np.uint64) * np.uint64(bits))
            words[place[mine]] |= np.bitwise_or.reduce(values, axis=1)
    raw = np.flatnonzero(chosen == ESCAPE)
    words[place[raw] + 1] = ids[at[raw]]
    word_of = np.append(place, len(words))
    return words, word_of[np.searchsorted(at, starts)]


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids (uint64) of consecutive words."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    is_raw = np.zeros(len(words), dtype=bool)
    last = -1
    for i in np.flatnonzero(selector == ESCAPE).tolist():  # a raw word can look like an escape
        if i != last:
            is_raw[i + 1], last = True, i + 1
    counts = np.ones(16, dtype=np.int64)
    for s, (count, _) in PACKINGS.items():
        counts[s] = count
    n = np.where(is_raw, 1, counts[selector])
    n[(selector == ESCAPE) & ~is_raw] = 0
    first = np.cumsum(n) - n
    out = np.empty(int(n.sum()), dtype=np.uint64)
    for s, (count, bits) in PACKINGS.items():
        mine = np.flatnonzero((selector == s) & ~is_raw)
        if len(mine):
            shift = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            out[first[mine][:, None] + np.arange(count)] = (words[mine][:, None] >> shift) & np.uint64((1 << bits) - 1)
    raw = np.flatnonzero(is_raw)
    out[first[raw]] = words[raw]
    return out


#: Most words: letters (of Latin-1), then marks. No apostrophe, which the tokenizer's pattern
#: knows, and no bar, which stands between words below.
#: Words stand on lines of their own; others than these give two empty groups.
_PLAIN = re.compile(r"^(?:([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{}~]*)|.*)$", re.M)
_PROBES = ["Then,", "ÊTRE", "straße...", "a<=", "Zu", "x!?"]
#: The same classes of ASCII bytes: 1 letters, 2 marks, 0 white space, 3 any other.
_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[[ord(c) for c in string.ascii_letters]] = 1
_CLASS[[ord(c) for c in string.punctuation if c not in "'|"]] = 2
_CLASS[[ord(c) for c in string.whitespace]] = 0


class WordEncoder(PartCache):
    """Encodes words (no white space) with a tokenizer file, without special tokens.

    Where the tokenizer lower-cases and splits letters from marks (probed: `plain`), a plain word is
    the model's tokens of its letters and of its marks. Other words are
    joined by bars and go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        super().__init__(self.encode)
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._bytes = {ord(c): "".join(byte_characters()[b] for b in c.encode())
                       for c in map(chr, range(0xA0, 0x100))}
        self._coded = [i.to_bytes(4, "little") for i in range(max(self._tokenizer.get_vocab().values()) + 1)]
        bar = self._encode_texts(["|"])[0]
        self._bar = int(bar[0]) if len(bar) == 1 else None
        self.plain = False
        self.plain = self.encode([w.encode() for w in _PROBES]) == self._encode_plain(
            *map(list, zip(*_PLAIN.findall("\n".join(_PROBES)), strict=True)))

    def _encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        return list(encode_texts(self._tokenizer, texts))

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        coded, tokenize = self._coded, self._model.tokenize
        return [b"".join([coded[t.id] for t in tokenize(p if p.isascii() else p.translate(self._bytes))]) for p in pieces]

    def _encode_plain(self, letters: list[str], marks: list[str]) -> list[bytes]:
        letters = "\n".join(letters).lower().split("\n")  # no letter of Latin-1 becomes two
        parts = dict.fromkeys(letters)
        parts.update(dict.fromkeys(marks))
        parts.pop("", None)
        known = dict(zip(parts, self._encode_pieces(list(parts)), strict=True))
        known[""] = b""
        return [known[a] + known[b] for a, b in zip(letters, marks, strict=True)]

    def encode(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(words)
        if self.plain:
            found = _PLAIN.findall(b"\n".join(words).decode())
            plain = [i for i, (a, _) in enumerate(found) if a]
            for i, ids in zip(plain, self._encode_plain([found[i][0] for i in plain], [found[i][1] for i in plain]), strict=True):
                out[i] = ids
        rest = [i for i, ids in enumerate(out) if ids is None]
        joined = [i for i in rest if b"|" not in words[i]] if self._bar is not None else []
        groups = [joined[i:i + 512] for i in range(0, len(joined), 512)]
        alone = [i for i in rest if b"|" in words[i]] if self._bar is not None else rest
        found = self._encode_texts([b" | ".join([words[i] for i in g]).decode() for g in groups]
                                   + [words[i].decode() for i in alone])
        for group, ids in zip(groups, found, strict=False):
            cuts = np.flatnonzero(ids == self._bar)
            if len(cuts) != len(group) - 1:
                raise ValueError("a word's ids hold the id of a bar")
            starts = [0, *(cuts + 1).tolist()]
            for i, a, b in zip(group, starts, [*cuts.tolist(), len(ids)], strict=True):
                out[i] = ids[a:b].tobytes()
        for i, ids in zip(alone, found[len(groups):], strict=True):
            out[i] = ids.tobytes()
        return out


_LOADED: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The encoder of a tokenizer file, kept for the life of the process."""
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def _cut_words(words: Words) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(parts, parts up to each text's end): plain ASCII words become their letters, lower-cased, and their marks, so
    that few distinct parts are left; other words stay as they are."""
    if not len(words.start):
        return words.terms(), words.word_offset[1:]
    kind = _CLASS[words.data]
    letter = kind == 1
    odd = kind == 3
    odd[1:] |= letter[1:] & (kind[:-1] == 2)  # a letter after a mark
    n_letters = np.add.reduceat(letter, words.start, dtype=np.int64)
    plain = (n_letters > 0) & ~np.logical_or.reduceat(odd, words.start) & letter[words.start]
    cut = words.start + n_letters
    marked = plain & (cut < words.end)
    length = words.end - words.start
    letters = words.data[words.inside]
    letters = np.where(np.repeat(plain, length), ASCII_LOWER[letters], letters)
    begin = np.sort(np.concatenate([words.start, cut[marked]]))
    end = np.sort(np.concatenate([words.end, cut[marked]]))
    before = np.append(0, np.cumsum(marked))
    return spans(letters, end - begin), (words.word_offset + before[words.word_offset])[1:]


def encoded(words: Words, encoder: PartCache, end_id: int, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(ids (uint64) of consecutive texts, each ended by `end_id`, how many each text has). The
    tokenizer drops white space, so a text's ids are those of its words; `plain`: see WordEncoder."""
    terms, last = _cut_words(words) if plain else (words.terms(), words.word_offset[1:])
    each = encoder.of(terms.dictionary.cast(pa.large_binary()).to_pylist())
    each.append(int(end_id).to_bytes(4, "little"))
    known = np.frombuffer(b"".join(each), dtype="<u4").astype(np.uint64)
    size = np.fromiter(map(len, each), np.int64, len(each)) // 4
    # the end stands after each text's words, as one more term
    parts = np.insert(terms.indices.to_numpy().astype(np.int64), last, len(each) - 1)
    n = size[parts]
    total = np.cumsum(n)
    ids = known[np.repeat((np.cumsum(size) - size)[parts] - (total - n), n) + np.arange(total[-1])]
    return ids, np.diff(total[last + np.arange(words.n_texts)], prepend=0)


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
              files: int | None = None) -> DataFrame:
    """Encodes every text, appends `end_id`, writes the files and returns them as read (BLOCKS)."""
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    ordered = (slim.withColumn("tie", F.xxhash64("text"))
               .repartitionByRange(files or shuffle_partitions(docs), "id", "tie")
               .sortWithinPartitions("id", "tie", "text").select("id", "text"))
    schema = BLOCKS.format(id=ordered.schema["id"].dataType.simpleString())

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = word_encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts.cast(pa.large_binary()), BLOCK_BYTES):
                ids, lengths = encoded(Words(texts.slice(a, b - a)), encoder, end_id, encoder.plain)
                packed, first = pack(ids, lengths)
                rows = pa.StructArray.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array(lengths), pa.array(first)], names=["id", "n", "word"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([lengths.sum()], pa.int64()),
                     pa.array([packed.astype("<u8").tobytes()], pa.binary()),
                     pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), rows)],
                    names=["part", "before", "n_ids", "words", "docs"])
                before += int(lengths.sum())

    return written(ordered.mapInArrow(blocks, schema), "token-ids")


def read_ids(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """Reads the files back: id, start (ids of all documents before it), n_tokens, ids_crc32 (of
    the ids as little-endian 32-bit integers) and, `with_ids`, the ids themselves."""
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = totals.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    # one row a file, so it may be broadcast
    rows = files.join(F.broadcast(starts), "part").select(
        (F.col("part_start") + F.col("before")).alias("start"), "words", "docs")
    id_type = files.schema["docs"].dataType.elementType["id"].dataType.simpleString()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("docs")
            for i in range(batch.num_rows):
                mine = docs.slice(i, 1).flatten()
                n = mine.field("n").to_numpy()
                ids = unpack(np.frombuffer(batch.column("words")[i].as_py(), dtype="<u8")).astype("<u4")
                ends = np.cumsum(n)
                crc = [zlib.crc32(ids[a:b].data) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                out = {"id": mine.field("id"), "start": pa.array(batch.column("start")[i].as_py() + ends - n),
                       "n_tokens": pa.array(n), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()),
                                                          pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(documents, f"id {id_type}, start long, n_tokens long, ids_crc32 long"
                           + ", ids array<long>" * with_ids)
