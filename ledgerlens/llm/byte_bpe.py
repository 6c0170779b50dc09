"""Byte-level BPE encoding and decoding over Arrow batches with the tokenizers library.

Byte-level BPE writes each byte as one printable character (`byte_characters`); a merge
rank file over bytes so becomes a vocabulary over characters, from which the library's
model is built. A text is cut before single spaces that precede a word, where no match of the
split pattern can cross, and distinct parts are encoded once.

Encoding gives, for each text, its ids and the character at which each id's bytes begin
(a byte inside a character counts as that character). Decoding reverses the byte table and
joins bytes before it reads them as UTF-8, so a character whose bytes lie in two ids comes
back whole; the stretches of ids that a caller decodes may begin or end inside one.

Defined results: a null text counts as empty and has no ids; special-token strings in a text
are ordinary text; rows are handled one by one, so repeated rows repeat; an empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import lean, small_batches
from .wordwise import PartCache, encode_texts
from .words import slices

#: Bytes of texts handled together.
SLICE_BYTES = 2 << 20

#: White space in UTF-8 (the Unicode property White_Space): fixed values.
_SPACE = (rb"[\t-\r ]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: A space that begins a match of the split pattern: the next character is no white space.
_CUT = re.compile(rb" (?!" + _SPACE + rb"|\Z)")


def byte_characters() -> list[str]:
    """byte -> character: printable Latin-1 bytes stand for themselves, the others take the
    code points from 256 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class ByteBPE:
    """The library's tokenizer for a rank file (lines of base64 token and rank)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = np.asarray([len(t) for t in self.tokens], dtype=np.int64)
        chars = byte_characters()
        #: each token as the library's vocabulary writes it, and the byte table turned round
        self.names = ["".join([chars[b] for b in t]) for t in self.tokens]
        self.byte_of = np.zeros(512, dtype=np.uint8)
        self.byte_of[[ord(c) for c in chars]] = np.arange(256)
        self._ranks, self._tokenizer = ranks, None  # decoding needs no tokenizer
        self.cache = PartCache(self._encode)

    def _encode(self, parts: list[bytes]) -> list[bytes]:
        """Parts after the first begin with a space, so the joined text is cut between them;
        the ids' byte lengths show where each part's ids end."""
        if self._tokenizer is None:
            self._tokenizer, self._ranks = _library_tokenizer(self._ranks), None
        out: dict[bytes, bytes] = {}
        spaced = [p for p in parts if p[:1] == b" " and len(p) > 1]
        groups = [spaced[i:i + 512] for i in range(0, len(spaced), 512)]
        alone = [p for p in parts if not (p[:1] == b" " and len(p) > 1)]
        texts = [b"".join(g).decode() for g in groups] + [p.decode() for p in alone]
        found = list(encode_texts(self._tokenizer, texts))
        for group, ids in zip(groups, found, strict=False):
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(p) for p in group]), side="left") + 1
            a = 0
            for part, b in zip(group, ends.tolist(), strict=True):
                out[part] = ids[a:b].tobytes()
                a = b
        out.update(zip(alone, (x.tobytes() for x in found[len(groups):]), strict=True))
        return [out[p] for p in parts]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cut = []
        for text in texts:
            first, *rest = _CUT.split(text) if text else [b""]
            cut.append(([first] if first else []) + [b" " + p for p in rest])
        known = self.cache.lookup(p for parts in cut for p in parts)
        return [b"".join(map(known.__getitem__, parts)) for parts in cut]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids: their characters, each turned back into its byte. A stretch may begin or end inside a
        character of the text; join the results of several stretches before reading them as UTF-8."""
        written = "".join(map(self.names.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return self.byte_of[np.frombuffer(written.encode("utf-16-le"), dtype="<u2")].tobytes()

    def offsets(self, ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(character at which each id begins, whether it begins inside a character) for the
        ids of `text` (its bytes)."""
        length = self.lengths[ids]
        begin = np.cumsum(length) - length
        inside = (text & 0xC0) == 0x80
        return (np.cumsum(~inside) - 1)[begin], inside[begin]

    def split_counts(self, ids: list[bytes], texts: list[bytes]) -> np.ndarray:
        """How many of each text's ids begin inside a character."""
        n = np.asarray([len(x) // 4 for x in ids], dtype=np.int64)
        inside = np.zeros(0, dtype=bool)
        if n.sum():
            inside = self.offsets(np.frombuffer(b"".join(ids), "<u4"), np.frombuffer(b"".join(texts), np.uint8))[1]
        ends, split = np.cumsum(n), np.append(0, np.cumsum(inside))
        return split[ends] - split[ends - n]


def _library_tokenizer(ranks: dict[bytes, int]):
    """A tokenizers BPE model whose merges follow from the ranks: a token merges the two parts
    into which the lower ranks split it."""
    from tokenizers import Tokenizer, models, pre_tokenizers
    chars = byte_characters()
    name = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1:
            parts = [token[i:i + 1] for i in range(len(token))]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
                if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                    raise ValueError(f"rank {rank} is no merge of two lower ranks")
                parts[best:best + 2] = [parts[best] + parts[best + 1]]
            merges.append((name[parts[0]], name[parts[1]]))
    tokenizer = Tokenizer(models.BPE({name[t]: r for t, r in ranks.items()}, merges))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    return tokenizer


_LOADED: dict[str, ByteBPE] = {}


def load(path: str) -> ByteBPE:
    """The tokenizer of a rank file, kept for the life of the process."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text",
           with_offsets: bool = False) -> DataFrame:
    """(id, ids binary of little-endian 32-bit integers, n_split; offsets array<int> if wanted).
    n_split counts the ids that begin inside a character."""
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    id_type = slim.schema["id"].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks)
        for batch in batches:
            column = batch.column("text").cast(pa.large_binary())
            for a, b in slices(column, SLICE_BYTES):
                texts = column.slice(a, b - a).to_pylist()
                ids = bpe.encode(texts)
                out = {"id": batch.column("id").slice(a, b - a), "ids": pa.array(ids, pa.binary()),
                       "n_split": pa.array(bpe.split_counts(ids, texts))}
                if with_offsets:
                    n = np.asarray([len(x) // 4 for x in ids], dtype=np.int64)
                    begin = bpe.offsets(np.frombuffer(b"".join(ids), "<u4"), np.frombuffer(b"".join(texts), np.uint8))[0] \
                        if n.sum() else n[:0]
                    ends = np.cumsum(n)
                    chars = np.cumsum([len(t.decode()) for t in texts])
                    base = np.repeat(np.append(0, chars[:-1]), n)
                    out["offsets"] = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()),
                                                              pa.array((begin - base).astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)

    return small_batches(slim).mapInArrow(lean(encoded), f"id {id_type}, ids binary, n_split long" + ", offsets array<int>" * with_offsets)


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """`encoded` (id, ids) with `decoded`, the bytes of the ids."""
    id_type = encoded.schema["id"].dataType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks)
        for batch in batches:
            column = batch.column("ids")
            for a, b in slices(column, 2 * SLICE_BYTES):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([bpe.decode(x) for x in part.column("ids").to_pylist()], pa.binary())],
                    names=[*part.schema.names, "decoded"])

    return small_batches(encoded).mapInArrow(lean(decoded), f"id {id_type}, ids binary, n_split long, decoded binary")


def round_trip(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text in one pass: identifier, n_tokens, ids_sha256, decoded_sha256,
    n_split. Only digests leave the task."""
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    id_type = slim.schema["id"].dataType.simpleString()

    def tripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks)
        for batch in batches:
            column = batch.column("text").cast(pa.large_binary())
            for a, b in slices(column, SLICE_BYTES):
                texts = column.slice(a, b - a).to_pylist()
                ids = bpe.encode(texts)
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column("id").slice(a, b - a),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
                    "n_split": pa.array(bpe.split_counts(ids, texts))})

    out = small_batches(slim).mapInArrow(lean(tripped), f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long")
    return out.withColumnRenamed("id", id_col)
