"""Encoding texts part by part with the tokenizers library, each distinct part once.

Both tokenizers split a text into parts that they encode one by one, so the ids of a text
are the ids of its parts in a row. Common parts are kept for the life of a Python worker
(at most `KEPT_PARTS` of them, so memory is bounded); the others are encoded once a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np

KEPT_PARTS = 250_000
#: Texts that go to the library at once: it returns offsets and texts of all their tokens too,
#: which take many times the bytes of the ids.
BATCH_TEXTS = 16


def encode_texts(tokenizer, texts: list[str]) -> Iterator[np.ndarray]:
    """The ids of each text, without special tokens."""
    for i in range(0, len(texts), BATCH_TEXTS):
        for e in tokenizer.encode_batch_fast(texts[i:i + BATCH_TEXTS], add_special_tokens=False):
            yield np.asarray(e.ids, dtype="<u4")


class PartCache:
    """part -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], kept: int = KEPT_PARTS):
        self._encode, self._kept, self._room = encode, {}, kept

    def of(self, parts: list[bytes]) -> list[bytes]:
        """The ids of distinct parts, in their order."""
        kept = self._kept
        known = list(map(kept.get, parts))
        new = [p for p, ids in zip(parts, known, strict=True) if ids is None]
        if new:
            found = self._encode(new)
            if self._room:
                kept.update(zip(new[:self._room], found, strict=False))
                self._room -= min(self._room, len(new))
            fill = iter(found)
            known = [next(fill) if ids is None else ids for ids in known]
        return known

    def lookup(self, parts: Iterable[bytes]) -> dict[bytes, bytes]:
        """A mapping of just `parts`."""
        distinct = list(dict.fromkeys(parts))
        return dict(zip(distinct, self.of(distinct), strict=True))
