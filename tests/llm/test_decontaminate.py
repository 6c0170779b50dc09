import hashlib
import random
import re

import numpy as np
import pytest

from ledgerlens.llm import catalog, decontaminate
from tests.conftest import SF_SMALL

from .cases import docs, rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(texts, items, width):
    """(doc_id, n_words, n_hit, items) of every document, sorted."""
    out = []
    for doc_id, text in texts:
        words, hit, found = words_of(text), set(), set()
        for item_id, item in items:
            own = words_of(item)
            k = min(width, len(own))
            wanted = {tuple(own[i:i + k]) for i in range(len(own) - k + 1)} if own and item_id is not None else set()
            for i in range(len(words) - k + 1) if wanted else ():
                if tuple(words[i:i + k]) in wanted:
                    hit.update(range(i, i + k))
                    found.add(str(item_id))
        out.append((doc_id, len(words), len(hit), sorted(found)))
    return sorted(out, key=str)


def plain_near(text, item, width, slop):
    """Whether some window of the item has all its words within width + slop words of the text."""
    words, own = words_of(text), words_of(item)
    k = min(width, len(own))
    for i in range(len(own) - k + 1) if own else ():
        need = set(own[i:i + k])
        if any(need <= set(words[j:j + k + slop]) for j in range(len(words))):
            return True
    return False


def run(df, items, width=10, slop=None):
    got = decontaminate.contamination(df, items, width, slop).collect()
    return sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got], key=str)


def items_for(spark, data):
    return spark.createDataFrame(data, "item_id long, text string, segment string, term string, row int")


def test_odd_rows(spark):
    data = rows()
    texts = [r[1] for r in data]
    items = [(7, texts[46], "s", "t", 1), (7, texts[46], "s", "t", 1), (10, "One", "s", "t", 1), (9, "a b c", None, None, 0),
             (1, None, "", "", 0), (2, " .,;", "", "", 0), (None, texts[46], "", "", 0), (11, texts[0].upper(), "", "", 0),
             (12, "\U0001f600 漢字 é", "", "", 0), (13, texts[56], "", "", 0)]
    got = run(docs(spark, data), items_for(spark, items))
    assert got == plain([(r[0], r[1]) for r in data], [i[:2] for i in items], 10)
    assert sum(r[2] > 0 for r in got) > 5


@pytest.mark.parametrize("seed", range(3))
def test_few_different_words_and_many_segments(spark, monkeypatch, seed):
    """Every term is frequent, windows overlap themselves, and segments and blocks are tiny."""
    rng = random.Random(seed)
    texts = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 12)))) for i in range(12)]
    monkeypatch.setattr(decontaminate, "SEGMENT_BYTES", 300)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    monkeypatch.setattr(decontaminate, "HELD", 50)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert run(df, spark.createDataFrame(items, "item_id long, text string"), 5) == plain(texts, items, 5)


def test_proximity(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)]
    texts = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 50)))) for i in range(80)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 7)))) for i in range(20)]
    df, it = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (set(r["items"]), set(r.near_items)) for r in decontaminate.contamination(df, it, 5, 2).collect()}
    for doc_id, text in texts:
        near = {str(i) for i, item in items if plain_near(text, item, 5, 2)}
        assert got[doc_id][0] | got[doc_id][1] == near
        assert not got[doc_id][0] & got[doc_id][1]


def test_spans_and_index(spark):
    index = decontaminate.build_index(spark.createDataFrame([(1, "x y the quick brown fox z the quick brown")], "doc_id long, text string"))
    found = decontaminate.matches(index, spark.createDataFrame([(5, "The quick brown")], "item_id long, text string"), 10)
    assert [(r.item_id, r.kind, r["first"], r["last"]) for r in found.orderBy("first").collect()] == [(5, "phrase", 2, 4), (5, "phrase", 7, 9)]
    the = index.where("term = 'the'").first()
    assert the.n == 2 and decontaminate.unpack(np.frombuffer(the.postings, np.uint8)).tolist() == [2, 5]


def test_packing():
    numbers = np.asarray([0, 1, 127, 128, 16383, 16384, 2**21, 2**31 - 1, 2**34 - 1])
    data, size = decontaminate.pack(numbers)
    assert decontaminate.unpack(data).tolist() == numbers.tolist() and size.tolist() == [1, 1, 1, 2, 2, 3, 4, 5, 5]


def test_empty_tables(spark):
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert run(some.limit(0), item) == []
    assert run(some, item.limit(0)) == [(1, 2, 0, [])]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    decontaminate.build_index(some)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_query_matches_plain_version(spark):
    texts = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()
    want = [(d, n, hit, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), hit > 0)
            for d, n, hit, i in plain([tuple(r) for r in texts], [tuple(r) for r in items], 10)]
    got = catalog.op11_decontaminate(spark, SF_SMALL).drop("n_near_items").collect()
    assert sorted([tuple(r) for r in got], key=str) == sorted(want, key=str)
