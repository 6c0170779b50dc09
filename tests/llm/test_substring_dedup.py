from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import sketch, substring_dedup
from ledgerlens.llm.words import Words, run_hash

from .cases import SCHEMA, as_rows, docs, rows


def expected(data, width):
    least = {}
    split = [(r[0], (r[1] or "").encode().split()) for r in data]
    for i, w in split:
        if i is not None:
            for a in range(len(w) - width + 1):
                k = tuple(w[a:a + width])
                least[k] = min(least.get(k, i), i)
    out = Counter()
    for i, w in split:
        gone = set()
        if i is not None:
            for a in range(len(w) - width + 1):
                if least[tuple(w[a:a + width])] < i:
                    gone.update(range(a, a + width))
        out[(i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode())] += 1
    return out


def test_matches_brute_force(spark):
    for width in (13, 3):
        got = substring_dedup.dedup_substrings(docs(spark), width=width)
        assert Counter(as_rows(got)) == expected(rows(), width)


def test_shared_passage_in_every_document(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    data = [(i, f"a{i} b{i} {passage} c{i} {passage}", *[None] * 12) for i in range(300)]
    got = substring_dedup.dedup_substrings(docs(spark, data).repartition(7))
    assert Counter(as_rows(got)) == expected(data, 13)


def test_repeated_identifier_with_other_texts(spark):
    text = " ".join(f"w{i}" for i in range(15))
    data = [(1, text, *[None] * 12), (2, text + " x", *[None] * 12), (2, "y " + text, *[None] * 12), (2, "y " + text, *[None] * 12)]
    assert Counter(as_rows(substring_dedup.dedup_substrings(docs(spark, data)))) == expected(data, 13)


def test_words_built_to_collide_stay(spark):
    """Words by the parity of their places' bits collide in every polynomial hash modulo 2^64."""
    def parity(n, flip):
        return "".join("ab"[(bin(i).count("1") & 1) ^ flip] for i in range(n))
    tail, head = " ".join(f"w{i}" for i in range(18)), " ".join(f"v{i}" for i in range(12))
    data = [(i, f"{head} {parity(n, flip)} {tail}", *[None] * 12) for i, (n, flip) in enumerate([(1024, 0), (1024, 1), (4096, 0), (4096, 1)])]
    assert Counter(as_rows(substring_dedup.dedup_substrings(docs(spark, data)))) == expected(data, 13)


def test_empty(spark):
    assert as_rows(substring_dedup.dedup_substrings(spark.createDataFrame([], SCHEMA))) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**28 - 1), max_size=300), st.integers(1, 28))
def test_gap_code_round_trip(cells, bits):
    cells = np.sort(np.asarray(cells, dtype=np.uint32) & np.uint32((1 << bits) - 1))
    assert sketch.unpack_gaps(sketch.pack_gaps(cells)).tolist() == cells.tolist()


def test_sketch_misses_no_repeat(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 500, 40)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(9)

    def hashes(column):
        return Words(column).hashes()

    seen = sketch.build(df, hashes, 8000)
    own = np.concatenate([Words(pa.array([t])).hashes() for t in texts])
    value, count = np.unique(own, return_counts=True)
    assert seen(value[count > 1]).all()
    fresh = Words(pa.array([" ".join(f"new{i}" for i in range(2000))])).hashes()
    assert seen(fresh).mean() < 0.05


def test_word_and_run_hashes_follow_content_not_place():
    words = Words(pa.array(["a bb a", None, " a  bb\n", "", "bb a a bb"]))
    h = words.hashes()
    assert words.count.tolist() == [3, 0, 2, 0, 4]
    assert h[0] == h[2] == h[3] == h[6] == h[7] and h[1] == h[4] == h[5] == h[8] and h[0] != h[1]
    first, run = words.windows(h, 2)
    assert run[0] == run[2] == run[5] and run[1] == run[3] and len(first) == 6
    assert run_hash(h, np.asarray([0]), np.asarray([2]))[0] == run[0]
    assert Words(pa.array(["Ab É"]), lower=True).hashes()[0] == Words(pa.array(["ab É"])).hashes()[0]


def test_marks_come_back_from_their_bytes():
    rng = np.random.default_rng(2)
    for n in (0, 1, 500):
        doc, text = np.sort(rng.integers(0, 9, n)), np.zeros(n, np.int64)
        marks = substring_dedup.Marks(doc, text, rng.integers(0, 2**31, n), rng.integers(0, 2**63, n).astype(np.uint64),
                                      rng.integers(0, 2**32, n).astype(np.uint32))
        back = substring_dedup.Marks.unpack(marks.pack())
        assert all(getattr(back, f).tolist() == getattr(marks, f).tolist() for f in substring_dedup.Marks.FIELDS)
