import glob
import hashlib
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import catalog, merkle
from tests.conftest import SF_SMALL

from .cases import SCHEMA, docs, rows

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    values = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return digest(*values)


def climb_up(nodes):
    """(root, per node the list of its siblings with their side)"""
    at, way = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, k in enumerate(at):
            if k ^ 1 < len(nodes):
                way[i].append((nodes[k ^ 1], "left" if k % 2 else "right"))
            else:
                way[i].append((None, "alone"))
            at[i] = k // 2
        nodes = [digest(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], way


def plain(data):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row, sorted."""
    groups = {}
    for doc_id, text, lang, source, n_chars in data:
        groups.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf(doc_id, source, lang, n_chars, text),
                                            (doc_id, source, lang, n_chars, text)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [climb_up([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order]
    root, top_way = climb_up([t[0] for t in trees])
    out = []
    for g, (subroot, ways), upper in zip(order, trees, top_way, strict=True):
        for (_, _, own, fields), way in zip(sorted(groups[g], key=lambda x: x[:3]), ways, strict=True):
            doc_id, source, lang, n_chars, text = fields
            changed = n_chars is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
            folded = leaf(doc_id, source, lang, n_chars + 1, text) if changed else own
            for sibling, side in way + upper:
                folded = digest(sibling, folded) if side == "left" else digest(folded, sibling or "")
            proof = digest(*[s for s, _ in way + upper if s])
            out.append((doc_id, own, subroot, root, proof, folded, folded == root))
    return sorted(out, key=str)


def run(df):
    return sorted([tuple(r) for r in catalog.merkle_digest(df).collect()], key=str)


def test_matches_plain_version_on_odd_rows(spark):
    data = [r[:5] for r in rows()] * 2
    got = run(docs(spark, [*rows(), *rows()]))
    assert got == plain(data)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 9, 17])
def test_group_sizes(spark, n):
    data = [(i, f"text {i}", "a" if i < n - 1 else None, "s", i, *[None] * 9) for i in range(n)]
    assert run(docs(spark, data)) == plain([r[:5] for r in data])


@pytest.mark.parametrize("hop", [1, 2, 6])
def test_every_hop_gives_the_same_proofs(spark, hop):
    df = docs(spark)
    args = (FIELDS, "doc_id", "lang")
    one = merkle.manifest(df, *args, hop=hop).select("doc_id", "leaf", "proof", "root", "verified")
    other = merkle.manifest(df, *args).select("doc_id", "leaf", "proof", "root", "verified")
    assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    assert one.where("verified").count() == df.count()


def test_many_blocks(spark, monkeypatch):
    """Trees higher than a block, with blocks of eight nodes."""
    monkeypatch.setattr(merkle, "BLOCK", 3)
    monkeypatch.setattr(merkle, "_LEVELS", merkle._LEVELS.replace("sequence(1, 12)", "sequence(1, 3)").replace("least(12,", "least(3,"))
    data = [(i, f"t{i}", ["x", "y", "é"][i % 3 if i < 90 else 0], "s", i) for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    claimed = {"n_chars": catalog.tampered_count()}
    got = merkle.manifest(df, FIELDS, "doc_id", "lang", claimed, hop=3)
    got = sorted(((r.doc_id, bytes(r.leaf).hex(), bytes(r.root).hex(), bytes(r.folded_root).hex(), r.verified) for r in got.collect()), key=str)
    assert got == sorted(((r[0], r[1], r[3], r[5], r[6]) for r in plain(data)), key=str)


def test_empty_table_and_settings(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    assert run(docs(spark).limit(0)) == []
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


def test_equal_rows_are_spread(spark):
    same = spark.createDataFrame([(7, "x", "en", "s", 1, *[None] * 9)], SCHEMA).select("doc_id", "lang")
    many = same.crossJoin(spark.range(0, 20_000, 1, 8).select()).withColumn("hash", F.lit(b"1"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # they are small here
    out = merkle.numbered(many.repartition(8), ["lang", "doc_id", "hash"], "spread")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert out.agg(F.count_distinct("number"), F.max("number")).first() == (20_000, 19_999)
    sizes = [pq.read_metadata(f).num_rows for f in
             glob.glob(spark.sparkContext.getCheckpointDir().removeprefix("file:") + "/spread-*/*.parquet")]
    assert sum(sizes) == 20_000 and max(sizes) < 10_000


def test_query_matches_plain_version(spark):
    table = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    got = sorted([tuple(r) for r in catalog.op13_merkle_manifest(spark, SF_SMALL).collect()], key=str)
    assert got == plain([tuple(r) for r in table.collect()])
