import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import catalog, ranked_search
from tests.conftest import SF_SMALL

from .cases import docs, rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(texts, items, k=20):
    """(item_id, rank, doc_id, score) of every item, sorted."""
    terms = [(d, TERM.findall((t or "").translate(LOWER))) for d, t in texts]
    terms = [(d, t) for d, t in terms if t]
    n_docs, total = len(terms), sum(len(t) for _, t in terms)
    df = Counter(x for _, t in terms for x in set(t))
    counts = [(d, len(t), Counter(t)) for d, t in terms]
    out = []
    for item_id, text in items:
        wanted = Counter(TERM.findall((text or "").translate(LOWER)))
        scored = []
        for d, n, c in counts:
            m = 100 - 25 + (25 * n * n_docs) // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 12 * m))
                    for x, q in wanted.items() if c[x])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item_id, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def run(df, items, k=20):
    return sorted([tuple(r) for r in ranked_search.ranked(df, items, k).collect()], key=str)


def test_odd_rows(spark):
    data = [*rows(), *[(100 + i, "alpha Beta gamma", "en", "a", 1, *[None] * 9) for i in range(30)]]
    items = [(1, "alpha beta Gamma alpha"), (2, None), (3, ""), (4, " .,;"), (None, "zeta"), (5, "nowhere"), (6, "one two"),
             (7, "\U0001f600 漢字 x1"), (6, "one two")]
    table = spark.createDataFrame([(*i, "x", 0) for i in items], "item_id long, text string, id string, score int")
    got = run(docs(spark, data), table)
    assert got == plain([(r[0], r[1]) for r in data], items)
    assert [r[2] for r in sorted(got, key=str) if r[0] == 1 and r[2] is None] == []


@pytest.mark.parametrize("seed", range(4))
def test_small_trees_blocks_and_ties(spark, monkeypatch, seed):
    """Many equal scores, trees of a few documents, items in several blocks."""
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    texts = [(i // 2 if i % 9 == 0 else i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 3, 3, 20])))) for i in range(400)]
    texts += [(rng.randrange(5000), "t1 t2 t39") for _ in range(150)]
    items = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(0, 9)))) for i in range(30)]
    monkeypatch.setattr(ranked_search, "TREE_DOCS", (16, 40))
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", 150)
    monkeypatch.setattr(ranked_search, "STEP_DOCS", 16)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert run(df, spark.createDataFrame(items, "item_id long, text string"), 5) == plain(texts, items, 5)


def test_large_scores_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "_EXACT", 1)  # integers instead of doubles
    data = [(r[0], r[1]) for r in rows()]
    items = [(1, "alpha beta gamma " * 50)]
    assert run(docs(spark), spark.createDataFrame(items, "item_id long, text string")) == plain(data, items)


def test_pruning_leaves_out_pairs_but_no_result():
    rng = np.random.default_rng(3)
    groups = rng.integers(0, 20, 2000)
    cells = np.zeros((2000, 200))
    for i, g in enumerate(groups):
        cells[i, rng.choice(10, 5, replace=False) + 10 * g] = rng.integers(1, 100, 5)
    queries = np.zeros((40, 200))
    for i in range(40):
        queries[i, rng.choice(10, 4, replace=False) + 10 * (i % 20)] = rng.integers(1, 50, 4)
    items = ranked_search.Tree(queries, np.ones(200), ranked_search.LEAF_ITEMS)
    tree = ranked_search.Tree(cells, np.ones(200), ranked_search.LEAF_DOCS)
    best = ranked_search.Best(40, 10, np.zeros(40, np.int64))
    scored = ranked_search.search(items, tree, best, np.arange(2000), np.zeros(2000, bool))
    assert scored < 40 * 2000 / 4
    want = queries @ cells.T
    for i in range(40):
        order = np.lexsort((np.arange(2000), -want[i]))[:10]
        assert best.id[i].tolist() == order.tolist() and best.score[i].tolist() == want[i][order].astype(int).tolist()


def test_empty_tables(spark):
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert run(some.limit(0), item) == run(some, item.limit(0)) == run(spark.createDataFrame([(1, " ")], some.schema), item) == []
    assert run(some, item) == plain([(1, "a b")], [(1, "a b")])


def test_query_matches_plain_version(spark):
    texts = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()
    got = catalog.op12_dual_tree(spark, SF_SMALL).collect()
    assert sorted([tuple(r) for r in got], key=str) == plain([tuple(r) for r in texts], [tuple(r) for r in items])
