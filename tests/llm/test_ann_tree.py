import math

import numpy as np
import pytest

from ledgerlens.llm import ann_tree

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, ids long, leaf int, pid long"


def brute(data, k=10):
    usable = {}
    for i, v, *_ in data:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 3:
            usable[(i, tuple(np.float32(v)))] = np.asarray(np.float32(v), dtype=float)
    out = []
    for (i, _), q in usable.items():
        if i % 100 == 0:
            near = sorted((math.sqrt(((v - q) ** 2).sum()), j) for (j, _), v in usable.items() if j != i)
            out += [(i, r + 1, j, d) for r, (d, j) in enumerate(near[:k])]
    return sorted(out)


def search(spark, data):
    df = spark.createDataFrame([(*r, 1, "v", 2, 3, 4) for r in data], SCHEMA)
    return sorted(tuple(r) for r in ann_tree.nearest_neighbours(df, "id % 100 = 0").collect())


def close(a, b):
    return [x[:3] for x in a] == [x[:3] for x in b] and np.allclose([x[3] for x in a], [x[3] for x in b])


def test_odd_vectors_ties_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    data = [(100, [1.0, 0.0, 0.0]), (200, [1.0, 0.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 1.0]),
            (5, [nan, 1.0, 1.0]), (6, [inf, 1.0, 1.0]), (7, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (300, [0.0, 0.0, 0.0]),
            (8, [2.0, 0.0, 0.0]), (9, [0.0, 1.0, 0.0]), (10, [0.0, -1.0, 0.0]), (8, [2.0, 0.0, 0.0]), (400, [-1.0, 0.0, 0.0])]
    assert close(search(spark, data), brute(data))


def test_fewer_candidates_and_empty(spark):
    assert search(spark, []) == [] and search(spark, [(100, [1.0, 2.0, 3.0])]) == []
    two = [(100, [1.0, 2.0, 3.0]), (5, [1.0, 2.0, 4.0])]
    assert close(search(spark, two), brute(two))


def test_common_vector(spark):
    rng = np.random.default_rng(3)
    data = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else rng.normal(size=3).tolist()) for i in range(1200)]
    got, want = search(spark, data), brute(data)
    hot = [r for r in got if r[0] % 3 == 0]
    assert close(hot, [r for r in want if r[0] % 3 == 0])
    assert len(got) == len(want)


def test_recall_of_given_vectors(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    rows = spark.read.parquet(path).collect()
    ids, vectors = np.asarray([r.vec_id for r in rows]), np.asarray([r.embedding for r in rows], dtype=float)
    got = {}
    for q, _, v, s in (tuple(r) for r in ann_tree.nearest_neighbours(spark.read.parquet(path), "id % 100 = 0").collect()):
        got.setdefault(q, set()).add(v)
    hits = 0
    for q in ids[ids % 100 == 0]:
        gap = np.sqrt(((vectors - vectors[ids == q]) ** 2).sum(axis=1))
        gap[ids == q] = np.inf
        hits += len(got[q] & set(ids[np.lexsort((ids, gap))[:10]].tolist()))
    assert hits / (10 * len(got)) >= 0.9


@pytest.mark.parametrize("n", [1, 80, 81, 3000])
def test_tree(n):
    rng = np.random.default_rng(0)
    points = rng.normal(size=(n, 4))
    tree = ann_tree.Tree(points)
    leaf = tree.assign(points)
    assert leaf.min() >= 0 and leaf.max() < tree.n_leaves
    for q in points[:20]:
        assert sorted(tree.walk(q)) == list(range(tree.n_leaves))
    if n == 3000:
        first = [next(tree.walk(q)) for q in points]
        assert np.mean(np.asarray(first) == leaf) > 0.7
    same = ann_tree.Tree(np.ones((500, 4)))
    assert same.n_leaves == 1
