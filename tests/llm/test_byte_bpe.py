import base64
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from ledgerlens.llm import byte_bpe
from ledgerlens.llm.catalog import tokenizer_file

from .cases import SCHEMA, as_rows, docs, rows

RANKS = tokenizer_file("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_round_trip_matches_the_library(spark, library):
    want = Counter()
    for r in rows():
        ids = np.asarray(library.encode_ordinary(r[1] or ""), "<u4").tobytes()
        want[(r[0], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())] += 1
    got = byte_bpe.round_trip(docs(spark), RANKS)
    assert Counter(r[:4] for r in as_rows(got)) == want


def test_every_white_space_in_every_place(library):
    bpe = byte_bpe.load(RANKS)
    spaces = [chr(c) for c in [*range(9, 14), 0x1C, 0x1F, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029,
                               0x202F, 0x205F, 0x3000, 0xFEFF]]
    texts = [f"{p}a{s}{t} b{t}{s}c {s}d{s} {t}" for s in spaces for t in spaces for p in ("", " ", s)]
    for text, ids in zip(texts, bpe.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_split_characters_and_offsets(spark):
    bpe = byte_bpe.load(RANKS)
    text = "a \U0001f600一กx"
    ids = np.frombuffer(bpe.encode([text.encode()])[0], "<u4")
    assert bpe.decode(ids[:3].tobytes()) + bpe.decode(ids[3:].tobytes()) == text.encode()
    data = [(1, text, *[None] * 12), (2, None, *[None] * 12), (3, "xé yz", *[None] * 12)]
    for r in byte_bpe.encode(docs(spark, data), RANKS, with_offsets=True).collect():
        own = dict((d[0], d[1] or "") for d in data)[r.id]
        at, split = 0, 0
        for token, offset in zip(np.frombuffer(r.ids, "<u4").tolist(), r.offsets, strict=True):
            before = own.encode()[:at]
            split += (own.encode()[at] & 0xC0) == 0x80
            assert offset == len(before.decode(errors="ignore")) if (own.encode()[at] & 0xC0) != 0x80 else \
                own[offset].encode() and len(own[:offset].encode()) < at
            at += len(bpe.tokens[token])
        assert at == len(own.encode()) and split == r.n_split


def test_byte_table_reverses():
    chars = byte_bpe.byte_characters()
    assert len(set(chars)) == 256 and chars[ord("A")] == "A" and chars[0x20] == "Ġ"


def test_empty(spark):
    assert as_rows(byte_bpe.round_trip(spark.createDataFrame([], SCHEMA), RANKS)) == []
