import random
from collections import Counter

import pytest

from ledgerlens.llm import ngram_join
from ledgerlens.llm.components import components

from .cases import SCHEMA, as_rows, docs, rows

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, width):
    w = (text or "").encode().translate(LOW).split()
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def expected(data, width, percent):
    sets = [shingle_set(r[1], width) for r in data]
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * len(a | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], len(s), least.get(find(i), r[0])) for i, (r, s) in enumerate(zip(data, sets, strict=True)))


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_matches_brute_force(spark, width, percent):
    assert Counter(as_rows(ngram_join.jaccard_components(docs(spark), width, percent))) == expected(rows(), width, percent)


def test_a_cloud_of_near_copies(spark):
    """Copies of one text with 0 to 6 words changed: some link with the middle only, some with few
    others, some with none; a second cloud shares a passage with the first."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    other = base[:20] + [f"v{rng.randrange(400)}" for _ in range(100)]
    data = []
    for i in range(240):
        text = list(base if i % 3 else other)
        for _ in range(rng.randrange(7)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(60)}"
        data.append((1000 - i, " ".join(text[rng.randrange(3):]), *[None] * 12))
    assert Counter(as_rows(ngram_join.jaccard_components(docs(spark, data), 4, 85))) == expected(data, 4, 85)


def test_chains_link_all(spark):
    """Neighbours of a sliding window link, far ones do not; the component is the whole chain."""
    stream = [f"s{i}" for i in range(300)]
    data = [(i, " ".join(stream[4 * i:4 * i + 100]), *[None] * 12) for i in range(40)]
    want = expected(data, 4, 85)
    assert {c for _, _, c in want} == {0}
    assert Counter(as_rows(ngram_join.jaccard_components(docs(spark, data), 4, 85))) == want


def test_one_of_each_group(spark):
    df = docs(spark)
    out = ngram_join.one_of_each_group(df)
    assert out.columns == df.columns
    want = {i for i, _, c in expected(rows(), 5, 80) if i == c}
    assert {r.doc_id for r in out.collect()} == want


def test_empty_and_wordless(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert as_rows(ngram_join.jaccard_components(empty)) == []
    data = [(1, None, *[None] * 12), (2, "", *[None] * 12), (3, " \n", *[None] * 12)]
    assert sorted(as_rows(ngram_join.jaccard_components(docs(spark, data)))) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(200, 260)] + [(5, 5), (7, 200)]
    got = dict(as_rows(components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {**{i: 100 for i in range(100, 141)}, 7: 7, **{x: 7 for x in range(200, 260)}}


def parity_word(n, flip):
    """Bytes by the parity of their place's bits: it and its complement collide in every polynomial hash modulo 2^64."""
    return "".join("ab"[(bin(i).count("1") & 1) ^ flip] for i in range(n))


def test_words_built_to_collide_do_not_link(spark):
    rest = " ".join(f"w{i}" for i in range(30))
    data = [(i, f"{parity_word(n, flip)} {rest[:20]} {parity_word(n, flip)}", *[None] * 12)
            for i, (n, flip) in enumerate([(1024, 0), (1024, 1), (2048, 0), (2048, 1)])]
    assert Counter(as_rows(ngram_join.jaccard_components(docs(spark, data), 4, 85))) == expected(data, 4, 85)


def test_kept_rows_keep_columns_of_any_name(spark):
    names = ["__id", "__hash", "row", "own_id", "own_hash", "hash", "id", "component_id"]
    df = spark.createDataFrame([(i, "a b c d e f g" if i < 3 else f"text {i} of its own", *[f"{n}{i}" for n in names]) for i in range(6)],
                               "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = ngram_join.one_of_each_group(df, 5, 80)
    assert kept.schema == df.schema and sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5]
    assert all(r[n] == f"{n}{r.doc_id}" for r in kept.collect() for n in names)
