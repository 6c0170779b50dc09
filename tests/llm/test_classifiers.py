import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import quality, toxicity

from .cases import SCHEMA, docs, rows

LABELS = "doc_id long, quality int, toxic int, text string, y0 double"
SMALL = "/root/testdata/sf0.01"


def corpus(n=240, seed=2):
    """Good prose and junk; toxic words in some of both."""
    rng = random.Random(seed)
    good = ["the", "river", "runs", "under", "old", "bridges", "and", "quiet", "towns", "sleep"]
    data, labels = [], []
    for i in range(n):
        junk, toxic = rng.random() < 0.3, rng.random() < 0.2
        w = [rng.choice(good) for _ in range(rng.randrange(20, 60))]
        if junk:
            w = [x.upper() + "!!" for x in w] if rng.random() < 0.5 else [x[::-1] + "###" for x in w]
        for _ in range(3 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["grumbag", "snotface"]))
        data.append((i, " ".join(w), *[None] * 12))
        labels.append((i, int(not junk), int(toxic), None, None))
    return data, labels


@pytest.fixture(scope="module")
def made(spark):
    data, labels = corpus()
    return data, labels, docs(spark, data), spark.createDataFrame(labels[::2], LABELS)


def test_quality_keeps_good_held_out_documents(made):
    data, labels, df, known = made
    out = {r.doc_id: r.importance for r in quality.classify(df, known).collect()}
    held = labels[1::2]
    good = [out[r[0]].kept for r in held if r[1]]
    junk = [out[r[0]].kept for r in held if not r[1]]
    assert np.mean(good) >= 0.98 and np.mean(junk) <= 0.1


def test_quality_is_a_gumbel_top_k(made):
    _, _, df, known = made
    ratio, least, cut = quality.resample(df, known)
    out = quality.classify(df, known).collect()
    keys = sorted((r.importance.sample_key for r in out), reverse=True)
    k = sum(r.importance.log_weight >= least for r in out)
    assert keys[k - 1] == cut and sum(r.importance.kept for r in out) == k
    noise = [r.importance.sample_key - quality.TEMPER * r.importance.log_weight for r in out]
    assert abs(np.mean(noise) - 0.5772) < 0.3 and np.std(noise) > 0.8


def test_quality_weights_match_a_plain_loop(made):
    data, _, df, known = made
    ratio = quality.fit(df, known)
    got = {r.doc_id: r.importance.log_weight for r in quality.classify(df, known).collect()}
    for i, text, *_ in data[:40]:
        b = text.encode()
        grams = [int.from_bytes(b[j:j + 4], "little") * 2654435761 % 2**32 >> 16 for j in range(len(b) - 3)]
        assert abs(got[i] - sum(ratio[g] for g in grams) / (len(grams) + quality.PRIOR_NGRAMS)) < 1e-9


def test_quality_odd_rows(spark, made):
    known = made[3]
    df = docs(spark)
    out = quality.classify(df, known)
    assert out.columns == [*df.columns, "importance"] and out.count() == len(rows())
    assert all(r.importance.log_weight == 0 for r in out.collect() if not r.text)
    assert quality.keep_good(df, known).columns == df.columns
    none = known.limit(0)
    assert all(r.importance.kept for r in quality.classify(df, none).collect())
    assert quality.classify(spark.createDataFrame([], SCHEMA), known).count() == 0


def test_kth_largest(spark):
    rng = np.random.default_rng(1)
    for values in (rng.normal(size=900), np.repeat([1.0, 2.0], 400), np.full(600, -3.5), [5.0]):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        ordered = sorted(values, reverse=True)
        for k in sorted({1, len(values) // 3 + 1, len(values)}):
            assert quality.kth_largest(df, "v", k, bins=16) == ordered[k - 1]


def test_chain_finds_held_out_toxic_documents(made):
    data, labels, df, known = made
    chain = toxicity.fit(df, known.withColumn("junk", 1 - F.col("quality")), ["junk", "toxic"])
    assert [len(m.extra) for m in chain.models] == [0, 1]
    out = {r.doc_id: r for r in toxicity.score(df, chain, ["junk", "toxic"]).collect()}
    held = labels[1::2]
    assert np.mean([out[r[0]].toxic == bool(r[2]) for r in held]) >= 0.98
    assert np.mean([out[r[0]].junk == (not r[1]) for r in held]) >= 0.95


def test_later_models_see_out_of_fold_log_odds():
    """A category that repeats the first one is learned from the first one's log odds alone."""
    rng = np.random.default_rng(0)
    y = (np.arange(200) % 4 == 0).astype(float)
    texts = [np.unique(np.append(rng.integers(10, 60, 8).astype(np.uint64), np.uint64(1 if v else 2))) for v in y]
    chain = toxicity.train_chain(texts, np.column_stack([y, y]))
    assert chain.models[1].extra[0] > 0
    doc = np.repeat(np.arange(200), [len(t) for t in texts])
    odds = chain.log_odds(doc, np.concatenate(texts), 200)
    assert ((odds[:, 1] >= chain.thresholds[1]) == (y == 1)).all()


def test_chain_odd_rows(spark, made):
    known, df = made[3], docs(spark)
    out = toxicity.classify(df, known, ["toxic"])
    assert out.columns == ["doc_id", "p_toxic", "toxic"] and out.count() == len(rows())
    assert not any(r.toxic for r in toxicity.classify(df, known.limit(0), ["toxic"]).collect())
    one_value = toxicity.classify(df, known.withColumn("toxic", F.lit(1)), ["toxic"])
    assert all(r.toxic for r in one_value.collect())
    assert toxicity.classify(spark.createDataFrame([], SCHEMA), known, ["toxic"]).count() == 0


def test_features_of_marks_capitals_and_repeats():
    texts = ["Word word!! x", "WORD", "word", None, "", "a a"]
    found = toxicity.distinct_features(pa.array(texts))
    assert [len(f) for f in found] == [4, 2, 1, 0, 0, 2]
    assert set(found[2]) <= set(found[1]) and set(found[2]) <= set(found[0])


def test_given_tables_catch_toxic_and_leave_clean(spark):
    """On the given documents (whole tables): precision and recall against all labels."""
    from ledgerlens.llm import catalog
    out = catalog.op4_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", F.col("toxic").alias("true"))
    t = out.join(labels, "doc_id").groupBy("toxic", "true").count().collect()
    n = {(r.toxic, r.true): r["count"] for r in t}
    assert n[(True, 1)] / (n[(True, 1)] + n.get((False, 1), 0)) >= 0.9
    assert n.get((True, 0), 0) <= 0.005 * n[(False, 0)]


def test_kept_documents_keep_columns_of_any_name(spark, made):
    data, _, _, known = made
    names = ["importance", "row", "id", "log_weight", "__log_weight", "label_id", "good", "key"]
    schema = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)
    df = spark.createDataFrame([(r[0], r[1], *[f"{n}{r[0]}" for n in names]) for r in data], schema)
    kept = quality.keep_good(df, known)
    assert kept.schema == df.schema
    got = kept.collect()
    assert len(got) > 10 and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)
