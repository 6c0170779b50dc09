"""Words of Arrow text columns as numpy arrays, and 64-bit hashes of words and word windows.

A word is a maximal run of bytes other than space and 0x09-0x0D (in UTF-8 this is the same
as the character class `[^\\x20\\x09-\\x0D]+`). A null text has no words. Everything below
works on whole texts; callers cut an Arrow batch into slices of bounded bytes with
`slices`, and only a single text longer than the bound makes a larger slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Between maximal runs of digits, a-z and characters outside ASCII (after A-Z is lower-cased).
NOT_ALPHANUMERIC = np.zeros(256, dtype=bool)
NOT_ALPHANUMERIC[:128] = True
NOT_ALPHANUMERIC[ord("0"):ord("9") + 1] = NOT_ALPHANUMERIC[ord("a"):ord("z") + 1] = False

#: byte -> byte, A-Z lower-cased
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[ord("A"):ord("Z") + 1] += 32

_MASK = (1 << 64) - 1
# the key of the word hash and the odd multipliers of the polynomials over it (fixed, so that every task and rerun agrees)
_KEY = b"words of a corpus"
_MIXED = np.asarray([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD], dtype=np.uint64)
_WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most `max_bytes` text bytes each (one row at least)."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size)
    a, n = 0, len(size)
    while a < n:
        base = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, base + max_bytes, side="right")))
        yield a, b
        a = b


class Words:
    """Words of consecutive texts: byte spans [start, end) in `data`, and their text's number."""

    def __init__(self, column: pa.Array, lower: bool = False, between: np.ndarray = _SPACE):
        """`between`: which byte values lie between words (after lower-casing A-Z, if `lower`)."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
        raw = column.buffers()[2]
        whole = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
        data = whole[offsets[0]:offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.data = ASCII_LOWER[data] if lower else data
        self.inside = inside = ~between[self.data]
        first = np.zeros(len(data) + 1, dtype=bool)
        first[self.offsets] = True
        begins, ends = inside.copy(), inside.copy()
        if len(data):
            begins[1:] &= ~inside[:-1] | first[1:-1]
            ends[:-1] &= ~inside[1:] | first[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.n_texts = n
        #: words before each text; the words of text i are [word_offset[i], word_offset[i + 1])
        self.word_offset = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.word_offset)
        self.text = np.repeat(np.arange(n), self.count)

    def terms(self) -> pa.DictionaryArray:
        """The words themselves, each distinct one stored once."""
        return spans(self.data[self.inside], self.end - self.start)

    def hash_pair(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes a word. Words of up to 16 bytes become two numbers, which with the length determine
        the word, and are mixed two ways; longer words take the halves of a keyed cryptographic hash. So no two
        words are made to collide by how they are built."""
        length = self.end - self.start
        halves = np.zeros((2, len(length)), dtype=np.uint64)
        at = np.flatnonzero(length <= 16)
        for j in range(16):
            at = at[length[at] > j]
            halves[j >> 3, at] |= self.data[self.start[at] + j].astype(np.uint64) << np.uint64(8 * (j & 7))
        x = mix(halves[0] ^ _MIXED[0])
        y = mix(halves[1] + length.astype(np.uint64) * _MIXED[1] + _MIXED[2])
        first, second = mix(x + y * _MIXED[3]), mix(y ^ (x * _MIXED[1] + _MIXED[0]))
        for i in np.flatnonzero(length > 16).tolist():
            digest = blake2b(self.data[self.start[i]:self.end[i]], digest_size=16, key=_KEY).digest()
            first[i], second[i] = np.frombuffer(digest, dtype="<u8")
        return first, second

    def hashes(self) -> np.ndarray:
        """One 64-bit hash a word."""
        return self.hash_pair()[0]

    def windows(self, hashes: np.ndarray, width: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of `width` words that lies in one text."""
        n = len(hashes)
        if n < width:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.text[:n - width + 1] == self.text[width - 1:])
        return first, run_hash(hashes, first, first + width, which)


def spans(letters: np.ndarray, lengths: np.ndarray) -> pa.DictionaryArray:
    """Consecutive stretches of UTF-8 bytes as strings, each distinct one stored once."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()


def run_hash(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of each run [first, last) of word hashes; `which` picks one of two hashes."""
    power, inverse = powers(_WORD_BASES[which], len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * power[:-1], out=total[1:])
    width = (last - first).astype(np.uint64)
    return mix((total[last] - total[first]) * inverse[first] + width * np.uint64(_WORD_BASES[1 - which]))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n (kept for the next call)."""
    kept = _POWERS.get(base)
    if kept is None or len(kept[0]) < n:
        inverse = pow(base, -1, 1 << 64)
        kept = _POWERS[base] = (_geometric(base, n), _geometric(inverse, n))
    return kept[0][:n], kept[1][:n]


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), dtype=np.uint64)
    done, step = 1, base & _MASK
    while done < n:  # doubles the filled part: out[done:2 done] = out[:done] * base^done
        take = min(done, n - done)
        out[done:done + take] = out[:take] * np.uint64(step)
        done, step = done + take, (step * step) & _MASK
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
