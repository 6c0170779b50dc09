import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import simple8b
from ledgerlens.llm.catalog import tokenizer_file

from .cases import SCHEMA, docs, rows

WORD = "word_bpe_49k.json"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 50_000), st.integers(0, 2**64 - 1)),
                         min_size=1, max_size=70), min_size=1, max_size=5))
def test_pack_round_trip(documents):
    lengths = np.asarray([len(d) for d in documents])
    ids = np.asarray([x for d in documents for x in d], dtype=np.uint64)
    words, first = simple8b.pack(ids, lengths)
    assert simple8b.unpack(words).tolist() == ids.tolist()
    for d, a, b in zip(documents, first.tolist(), [*first[1:].tolist(), len(words)], strict=True):
        assert simple8b.unpack(words[a:b]).tolist() == d  # every document alone


def test_words_hold_what_their_selectors_say():
    words, _ = simple8b.pack(np.arange(1, 41, dtype=np.uint64) % 2, np.asarray([40]))
    assert [int(w >> np.uint64(60)) for w in words] == [2, 6]  # thirty ids of two bits would do too, of one bit fit


def test_documents_side_by_side_pack_as_alone():
    made = np.random.default_rng(3)
    documents = [made.integers(0, 1 << int(made.integers(1, 40)), int(made.integers(1, 90)), dtype=np.uint64) for _ in range(3 * simple8b.FEW)]
    words, first = simple8b.pack(np.concatenate(documents), np.asarray([len(d) for d in documents]))
    for d, a, b in zip(documents, first.tolist(), [*first[1:].tolist(), len(words)], strict=True):
        assert words[a:b].tolist() == simple8b.pack(d, np.asarray([len(d)]))[0].tolist()


def test_the_library_gets_few_texts_at_once():
    from ledgerlens.llm import wordwise
    asked = []

    class Library:
        def encode_batch_fast(self, texts, add_special_tokens):
            asked.append(len(texts))
            return [type("Coded", (), {"ids": [len(t)]}) for t in texts]
    texts = ["x" * i for i in range(100)]
    assert [x.tolist() for x in wordwise.encode_texts(Library(), texts)] == [[i] for i in range(100)]
    assert max(asked) <= wordwise.BATCH_TEXTS and sum(asked) == 100


def test_words_of_a_block_are_looked_up_once_each():
    """Per occurrence, words go through arrays alone."""
    import pyarrow as pa
    from ledgerlens.llm.wordwise import PartCache
    from ledgerlens.llm.words import Words
    asked = []
    cache = PartCache(lambda parts: asked.extend(parts) or [p[:1] * 4 * len(p) for p in parts], kept=0)
    ids, lengths = simple8b.encoded(Words(pa.array(["a bb a", None, "", "bb\tbb a "])), cache, 7)
    assert sorted(asked) == [b"a", b"bb"] and lengths.tolist() == [5, 1, 1, 6]
    a, b = int.from_bytes(b"aaaa", "little"), int.from_bytes(b"bbbb", "little")
    assert ids.tolist() == [a, b, b, a, 7, 7, 7, b, b, b, b, a, 7]


def check(spark, data, **how):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_file(WORD))
    files = simple8b.write_ids(docs(spark, data), tokenizer_file(WORD), 2, **how)
    got = sorted(simple8b.read_ids(files).collect(), key=lambda r: r.start)
    ordered = sorted(data, key=lambda r: (r[0] is not None, r[0]))
    assert [r.id for r in got] == [r[0] for r in ordered]
    start, by_id = 0, {}
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.asarray(r.ids, dtype="<u4").tobytes())
        start += r.n_tokens
        by_id.setdefault(r.id, []).append(r.ids)
    for r in data:
        assert tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2] in by_id[r[0]]


def test_files_match_the_library(spark):
    check(spark, rows(), files=3)


def test_words_that_the_shortcut_must_not_take():
    from tokenizers import Tokenizer
    path = tokenizer_file(WORD)
    tokenizer, encoder = Tokenizer.from_file(path), simple8b.word_encoder(path)
    words = ["it's", "'s", "O'Neill's", "é", "Éá", "ß!", "ǅ", "a1b2", "½x", "a|b", "|", "||", "<|endoftext|>x",
             "x<|startoftext|>", "straße...", "İ", "ﬁ", "Ω", "a‍b", "日本", "\x1c", "a\x85b", "A-B_c", "naïve,", "×÷"]
    known = encoder.lookup(w.encode() for w in words)
    for w in words:
        assert np.frombuffer(known[w.encode()], "<u4").tolist() == tokenizer.encode(w, add_special_tokens=False).ids, w


def test_small_cache_gives_the_same():
    from ledgerlens.llm.wordwise import PartCache
    cache = PartCache(lambda parts: [p * 2 for p in parts], kept=3)
    for _ in range(3):
        parts = [bytes([97 + i % 9]) for i in range(30)]
        assert all(cache.lookup(parts)[p] == p * 2 for p in parts)


@pytest.mark.parametrize("data", [[], [(5, None, None, None, None, *[None] * 9)]])
def test_empty(spark, data):
    files = simple8b.write_ids(spark.createDataFrame(data, SCHEMA), tokenizer_file(WORD), 2)
    assert [(r.id, r.start, r.n_tokens, r.ids) for r in simple8b.read_ids(files).collect()] == [(5, 0, 1, [2])] * len(data)


def test_plain_words_are_cut_and_lower_cased_before_they_are_counted():
    import pyarrow as pa
    from ledgerlens.llm.wordwise import PartCache
    from ledgerlens.llm.words import Words
    asked = []
    cache = PartCache(lambda parts: asked.extend(parts) or [b"\0\0\0\0" for _ in parts], kept=0)
    _, lengths = simple8b.encoded(Words(pa.array(["The the, THE,. A1 a-B", "", " It's the| É, -- "])), cache, 7, plain=True)
    assert sorted(asked) == sorted(w.encode() for w in ("the", ",", ",.", "A1", "a-B", "It's", "the|", "É,", "--"))
    assert lengths.tolist() == [8, 1, 5]
