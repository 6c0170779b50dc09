import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from ledgerlens.llm import byte_bpe, catalog

from .cases import SCHEMA, docs
from .test_exact_dedup import LOW
from .test_mixing import size
from .test_ngram_join import expected as near_groups

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """What goes into and comes out of every stage at the smallest size."""
    from ledgerlens.llm.tables import read_table, written
    out, docs_ = [], read_table(spark, SMALL, "documents")
    for name, stage in corpus_pipeline.STAGES:
        result = written(stage(spark, docs_, SMALL), "test")
        out.append((name, docs_, result))
        docs_ = result
    return out


def test_columns(steps):
    for _, before, after in steps[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes
    assert steps[-1][2].columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_quality_keeps_labelled_good(spark, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps[0][2].collect()}
    good = [i in kept for i, q in labels.items() if q == 1]
    junk = [i in kept for i, q in labels.items() if q == 0]
    assert sum(good) >= 0.97 * len(good) and sum(junk) <= 0.3 * len(junk)


def test_exact_dedup(steps):
    largest = {}
    for r in steps[1][1].collect():
        key = (r.text or "").translate(LOW)
        largest[key] = max(largest.get(key, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in steps[1][2].collect()) == sorted(largest.values())


def test_near_copies(steps):
    before = [(r.doc_id, r.text) for r in steps[2][1].collect()]
    want = {i for i, _, c in near_groups(before, 5, 80) if i == c}
    assert {r.doc_id for r in steps[2][2].collect()} == want


def test_mix(steps):
    before = {r.doc_id: r for r in steps[3][1].collect()}
    seen, words, total, longest = Counter(), defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before.values():
        total[r.source] += size(r.text)
        longest[r.source] = max(longest[r.source], size(r.text))
    for r in steps[3][2].collect():
        seen[r.doc_id] += 1
        words[r.source] += size(r.text)
        assert r == before[r.doc_id]  # whole, with its own columns
    assert max(seen.values()) <= 2
    assert all(w <= 2 * total[s] for s, w in words.items())
    over = sum(words.values()) - 1.5 * sum(total.values())
    assert -len(total) <= over <= sum(longest.values())


def test_run_gives_the_last_stage(spark, steps):
    want = Counter(map(tuple, steps[-1][2].collect()))
    assert Counter(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == want
    again = byte_bpe.round_trip(steps[-1][1], catalog.tokenizer_file("byte_bpe_50k.tiktoken"))
    assert Counter(map(tuple, again.collect())) == want


def test_stages_with_odd_rows_and_empty_tables(spark):
    for df in (docs(spark), spark.createDataFrame([], SCHEMA)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, df, SMALL).columns == df.columns
            stage(spark, df, SMALL).write.format("noop").mode("overwrite").save()


def test_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    for n in range(1, 14):
        assert sum(re.match(rf"op{n}_", x) is not None for x in names) == 1
    assert names["pipeline"] is corpus_pipeline.run and "op6_exact_dedup" in entry.oracle_sql()


def test_tasks_give_arrow_memory_back_after_each_batch(monkeypatch):
    import pyarrow as pa

    from ledgerlens.llm import byte_bpe, ngram_join, sketch, tables
    done = []

    class Pool:
        def release_unused(self):
            done.append("released")
    monkeypatch.setattr(pa, "default_memory_pool", Pool)

    def task(batches):
        for b in batches:
            done.append(b)
            yield b + 1
    assert list(tables.lean(task)(iter([1, 2]))) == [2, 3]
    assert done == [1, "released", 2, "released", "released"]
    for module in (byte_bpe, ngram_join, sketch):
        assert module.lean is tables.lean
