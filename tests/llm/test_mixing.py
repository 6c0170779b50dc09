import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import mixing
from ledgerlens.llm.tables import written

from .cases import SCHEMA, docs, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def size(text):
    return len(WORD.findall(text or ""))


def targets(data, weights=(5, 2, 1), share=1.5, most=2.0):
    total = defaultdict(int)
    for r in data:
        total[r[3]] += size(r[1])
    names = sorted((s for s in total if s is not None)) + ([None] if None in total else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, budget = set(), share * sum(total.values())
    while True:
        free = [s for s in names if s not in full]
        left = budget - sum(most * total[s] for s in full)
        got = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if got[s] > most * total[s]}
        if not over:
            return {s: most * total[s] if s in full else got[s] for s in names}, total
        full |= over


@pytest.fixture(scope="module")
def mixed(spark):
    schedule, documents = mixing.mix(written(mixing.sized(docs(spark)), "t"), block_words=64)
    return schedule.collect(), documents.collect()


def test_targets_and_takes(mixed):
    _, documents = mixed
    want, total = targets(rows())
    assert sorted((r.id, r.size) for r in documents if r.id is not None) == \
        sorted((r[0], size(r[1])) for r in rows() if r[0] is not None)
    taken = defaultdict(int)
    for r in documents:
        assert 0 <= r.taken <= 2 * r.size
        assert r.source_size == total[r.source]
        assert math.isclose(r.target, want[r.source], rel_tol=1e-12)
        taken[r.source] += r.taken
    for s, t in want.items():
        assert taken[s] == math.floor(t)


def test_schedule_is_even(mixed):
    """Every stretch of the schedule holds each source in nearly its share."""
    schedule, _ = mixed
    n = 1 + max(r.slot for r in schedule)
    slots = defaultdict(set)
    for r in schedule:
        slots[r.source].add(r.slot)
    for mine in slots.values():
        for upto in range(10, n, 10):
            # the discrepancy of golden-ratio points grows as the logarithm
                assert abs(sum(s < upto for s in mine) - len(mine) * upto / n) <= math.log2(n)


def test_rerun_agrees(spark, mixed):
    _, again = mixing.mix(written(mixing.sized(docs(spark).repartition(5, "lang")), "t"), block_words=64)
    key = lambda r: (str(r.id), r.taken, r.copy)
    assert sorted(map(key, again.collect())) == sorted(map(key, mixed[1]))


def test_mixed_documents(spark):
    """Whole documents only; a source goes over its target by less than its border document."""
    df = docs(spark)
    out = mixing.mixed_documents(df, block_words=64)
    assert out.columns == df.columns
    want, _ = targets(rows())
    whole = {(r[0], r[1]) for r in rows()}
    words, longest = defaultdict(int), defaultdict(int)
    for r in out.collect():
        assert (r.doc_id, r.text) in whole
        words[r.source] += size(r.text)
        longest[r.source] = max(longest[r.source], size(r.text))
    assert set(words) == {s for s, t in want.items() if t >= 1}
    assert all(math.floor(want[s]) <= w < want[s] + longest[s] for s, w in words.items())


def test_empty_and_no_words(spark):
    for data in ([], [(1, None, None, "a", None, *[None] * 9), (2, " ", None, None, 1, *[None] * 9)]):
        df = spark.createDataFrame(data, SCHEMA)
        _, documents = mixing.mix(written(mixing.sized(df), "t"))
        assert [(r.size, r.taken) for r in documents.collect()] == [(0, 0)] * len(data)
        assert mixing.mixed_documents(df).count() == 0


def test_word_count(spark):
    texts = [None, "", "  ", "a", " a\tb\nc\x0bd\x0ce\rf ", "a b c"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.word_count(F.col("t"))).collect()]
    assert got == [size(t) for t in texts]


def test_native_plan(spark):
    _, documents = mixing.mix(written(mixing.sized(docs(spark)), "t"))
    plan = documents._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
