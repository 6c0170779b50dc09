"""N-gram Jaccard join with prefix filters under several global token orders.

A document's set holds its distinct shingles of `width` lower-cased words (as 64-bit hashes).
Two sets link when 100 * |intersection| >= percent * |union|. Then, in any global order of the
tokens, the first |x| - ceil(percent/100 * |x|) + 1 tokens of both share one. The join uses
three orders: by document frequency and one hash, by frequency and another hash, and by the
frequency's power of two and a third hash. Pairs that share a prefix token in the first are
candidates; those that do not in the others as well are dropped, and the rest is verified.

Steps:
1. A count-min sketch of all shingles shows those that surely occur once. A document with too
   few other tokens links with nothing; only the remaining ones go on.
2. Equal sets become one class (a third of all documents may be one class).
3. Exact frequencies among classes drop further tokens and give the orders.
4. Links are not listed pair by pair within a group. In each bucket (prefix token) every class
   is first compared with a hub, the class with the fewest rare tokens, twice; connected classes
   form components. Then all pairs of a bucket that are still in different components are
   compared, within bounds by sizes and by the tokens left after their first common one. Pairs in the same component need no comparison, so no link
   between components is lost.

Defined results: a null text counts as empty; a document without words has an empty set and
links with nothing; one of fewer words than `width` has its whole sequence as one shingle; rows
with a null identifier take part, but name a component only if it has no other identifier;
repeated rows are equal sets; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .components import components
from .tables import lean, small_batches, text_bytes, written
from .words import Words, mix, run_hash, slices

HUB_ROUNDS = 2


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of all shingles, in the order of the texts."""
    words = Words(column, lower=True)
    hashes = words.hashes()
    first, out = words.windows(hashes, width)
    short = np.flatnonzero((words.count > 0) & (words.count < width))
    if not len(short):
        return words.text[first], out
    begin = words.word_offset[short]
    whole = run_hash(hashes, begin, begin + words.count[short])
    text = np.concatenate([words.text[first], short])
    order = np.argsort(text, kind="stable")
    return text[order], np.concatenate([out, whole])[order]


def _sets(rows: DataFrame, seen: object, width: int, percent: int, with_tokens: bool) -> DataFrame:
    """(id, text_hash, n, sig; tokens): sig, a 128-bit hash of the whole set, is null for documents that
    link with no other text; tokens are the hashes that may occur in other documents."""
    id_type = rows.schema["id"].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = seen.value
        for batch in batches:
            for a, b in slices(batch.column("text")):
                text, token = shingles(batch.column("text").slice(a, b - a), width)
                edge = np.searchsorted(text, np.arange(b - a + 1))
                n, sig, tokens = [], [], []
                for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    own = np.unique(token[i:j])
                    shared = own[repeated(own)]
                    n.append(len(own))
                    if len(own) and 100 * len(shared) >= percent * len(own):
                        sig.append(own.sum().tobytes() + mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum().tobytes())
                        tokens.append(shared.astype(np.int64))
                    else:
                        sig.append(None)
                        tokens.append(None)
                out = {"id": batch.column("id").slice(a, b - a), "text_hash": batch.column("text_hash").slice(a, b - a),
                       "n": pa.array(n, pa.int64()),
                       "sig": pa.array(sig, pa.binary())}
                if with_tokens:
                    out["tokens"] = pa.array(tokens, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)

    return small_batches(rows).mapInArrow(lean(sets), f"id {id_type}, text_hash long, n long, sig binary" + ", tokens array<long>" * with_tokens)


def _ranked(classes: DataFrame, percent: int) -> DataFrame:
    """(cid, n, shared, tokens, prefix1..3): tokens that other classes have; their places in
    each order follow those that no other class has."""
    exploded = classes.select("cid", "n", F.explode("tokens").alias("token"))
    frequency = exploded.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    orders = exploded.join(frequency, "token").select("cid", "n", F.struct(
        "df", F.xxhash64("token", F.lit(1)).alias("h"), "token").alias("o"))
    sets = (orders.groupBy("cid", "n").agg(F.sort_array(F.collect_list("o")).alias("o"))
            .withColumn("shared", F.size("o")).where(F.col("shared") * 100 >= F.col("n") * percent)
            .withColumn("prefix", (F.col("shared") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")))

    def prefix(order):
        return F.transform(F.slice(order, 1, F.col("prefix")), lambda x: x["token"])

    second = F.sort_array(F.transform("o", lambda x: F.struct(
        x["df"].alias("df"), F.xxhash64(x["token"], F.lit(2)).alias("h"), x["token"].alias("token"))))
    third = F.sort_array(F.transform("o", lambda x: F.struct(
        F.floor(F.log2(x["df"])).alias("df"), F.xxhash64(x["token"], F.lit(3)).alias("h"), x["token"].alias("token"))))
    return sets.select("cid", "n", "shared", F.transform("o", lambda x: x["token"]).alias("tokens"),
                       prefix(F.col("o")).alias("prefix1"), prefix(second).alias("prefix2"), prefix(third).alias("prefix3"))


def _bounds(percent: int):
    """Whether a pair whose first common token is this one can link: at best the rest of the side
    with fewer tokens left is common. A pair that links passes at its first common token."""
    common = F.least("rest_a", "rest_b")
    return common * 100 >= (F.col("n_a") + F.col("n_b") - common) * percent


def _verified(pairs: DataFrame, ranked: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: prefix filters of the other orders first, then the sets."""
    def side(s: str) -> DataFrame:
        return ranked.select(*[F.col(c).alias(f"{c}_{s}") for c in ("cid", "n", "tokens", "prefix2", "prefix3")])
    filters = F.arrays_overlap("prefix2_a", "prefix2_b") & F.arrays_overlap("prefix3_a", "prefix3_b")
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    linked = common * 100 >= (F.col("n_a") + F.col("n_b") - common) * percent
    return (pairs.join(side("a"), F.col("a") == F.col("cid_a")).join(side("b"), F.col("b") == F.col("cid_b"))
            .where(filters).where(linked).select("a", "b"))


def _with_component(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return postings.withColumn("comp", F.col("cid"))
    known = labels.select(F.col("node").alias("cid"), F.col("component"))
    return postings.join(known, "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")


def _links(ranked: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the classes that link with another."""
    # rest: shared tokens from this one on
    postings = ranked.select("cid", "n", "shared", F.posexplode("prefix1").alias("pos", "token"))
    postings = written(postings.select("cid", "n", (F.col("n") - F.col("shared")).alias("rare"),
                                       (F.col("shared") - F.col("pos")).alias("rest"), "token"), "postings")
    edges = labels = first = tested = None
    for _ in range(HUB_ROUNDS):
        now = _with_component(postings, labels)
        if first is not None:  # those that the first hub's component does not hold
            now = now.join(_hub_components(first, labels), "token").where("comp <> hub_comp").drop("hub_comp")
        hub = now.groupBy("token").agg(F.min(F.struct("rare", "cid", "n", "rest")).alias("hub"))
        hub = hub.select("token", F.col("hub.cid").alias("b"), F.col("hub.n").alias("n_b"), F.col("hub.rest").alias("rest_b"))
        if first is None:
            hub = written(hub, "hubs")
            first = hub.select("token", F.col("b").alias("hub"))
        pairs = written(now.withColumnsRenamed({"cid": "a", "n": "n_a", "rest": "rest_a"}).join(hub, "token")
                        .where("a <> b").where(_bounds(percent)).select("a", "b").distinct(), "hub-pairs")
        found = written(_verified(pairs, ranked, percent), "hub-links")
        edges = found if edges is None else edges.unionByName(found)
        tested = pairs if tested is None else tested.unionByName(pairs)
        labels = components(edges)
    # every pair of a bucket in different components has a side outside its first hub's
    now = written(_with_component(postings, labels), "postings")
    least = now.groupBy("token").agg(F.min("n").alias("n_b"))
    left = now.withColumnsRenamed({"cid": "a", "n": "n_a", "rest": "rest_a", "comp": "comp_a"}).drop("rare")
    left = left.join(_hub_components(first, labels), "token").where("comp_a <> hub_comp").drop("hub_comp")
    left = left.join(least, "token").where(
        F.col("rest_a") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("rest_a")) * percent).drop("n_b")
    right = now.withColumnsRenamed({"cid": "b", "n": "n_b", "rest": "rest_b", "comp": "comp_b"}).drop("rare")
    rest = (left.join(right, "token").where(F.col("comp_a") != F.col("comp_b")).where(_bounds(percent))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = written(_verified(written(rest.join(done, ["a", "b"], "left_anti"), "pairs"), ranked, percent), "links")
    return labels if more.isEmpty() else components(edges.unionByName(more))


def _hub_components(first: DataFrame, labels: DataFrame) -> DataFrame:
    return _with_component(first.withColumnRenamed("hub", "cid"), labels).select("token", F.col("comp").alias("hub_comp"))


def _groups(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: id, text_hash, n, component_id."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    expected = text_bytes(rows) / 6
    seen = docs.sparkSession.sparkContext.broadcast(
        sketch.build(rows.select("text"), lambda column: shingles(column, width)[1], expected, cells_each=2))
    members = written(_sets(rows, seen, width, percent, False), "members")
    classes = (_sets(rows, seen, width, percent, True).where("sig is not null").groupBy("sig")
               .agg(F.min("id").alias("least_id"), F.first("n").alias("n"), F.first("tokens").alias("tokens")))
    # written, so the numbers stay as they are
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    seen.unpersist()
    ranked = written(_ranked(classes, percent), "ranked")
    labels = _links(ranked, percent)
    groups = classes.select("sig", "least_id", F.col("cid").alias("node")).join(labels, "node", "left")
    groups = groups.withColumn("component", F.coalesce("component", "node"))
    names = groups.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = groups.join(names, "component").select(F.col("sig").alias("set"), "component_id")
    return members.join(named, F.col("sig") == F.col("set"), "left").select(
        "id", "text_hash", "n", F.coalesce("component_id", "id").alias("component_id"))


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """One row per document: identifier, n_shingles, component_id (the smallest identifier that
    links reach, its own included)."""
    return _groups(docs, width, percent, id_col, text_col).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_of_each_group(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose identifier is their component's smallest, with docs' own columns.
    Rows that repeat an identifier and text stay or go together."""
    groups = _groups(docs, width, percent, id_col, text_col)
    stays = groups.where(F.col("id").eqNullSafe(F.col("component_id"))).select("id", F.col("text_hash").alias("hash"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("own_id"),
                       F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("own_hash"))
    kept = rows.join(stays, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash")), "left_semi")
    return kept.select("row.*")
