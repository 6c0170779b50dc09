import hashlib
from collections import Counter, defaultdict

from ledgerlens.llm import exact_dedup

from .cases import SCHEMA, as_rows, docs, rows

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(data):
    groups = defaultdict(list)
    for r in data:
        groups[(r[1] or "").translate(LOW)].append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        stays = False
        for i in sorted(ids, key=lambda x: (x is None, x)):
            kept = i == keep and not stays
            stays = stays or kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


def test_groups_match_brute_force(spark):
    data = rows()
    assert Counter(as_rows(exact_dedup.dedup_groups(docs(spark)))) == expected(data)


def test_large_group_is_spread_and_exact(spark):
    data = [(i, "Same TEXT" if i % 3 else f"text {i}", None, None, None, *[None] * 9) for i in range(3000)]
    out = exact_dedup.dedup_groups(docs(spark, data))
    assert Counter(as_rows(out)) == expected(data)
    keyed = docs(spark, data).selectExpr("doc_id id", "text").selectExpr(
        "*", "cast(substring(lower(text), 1, 32) as binary) prefix", "xxhash64(lower(text)) hash")
    assert exact_dedup._large_texts(keyed, 3000, 8).count() == 1


def test_deduplicate_keeps_columns_and_one_row(spark):
    df = docs(spark)
    out = exact_dedup.deduplicate(df)
    assert out.columns == df.columns
    texts = [(r.text or "").translate(LOW) for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({(r[1] or "").translate(LOW) for r in rows()})


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert as_rows(exact_dedup.dedup_groups(empty)) == []
    assert exact_dedup.deduplicate(empty).columns == empty.columns


def test_native_plan(spark):
    plan = exact_dedup.dedup_groups(docs(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
