"""Merkle manifest of a dataset, checked by a recursive query that climbs from every leaf.

A row's leaf is the hash of its fields. The leaves of one group (language), in the order of their
identifiers, are hashed two by two, level by level, up to the group's root; the roots of all
groups, in the order of the groups, likewise give the root of the dataset. A run of two at the
end of a level may hold one node only, which is then hashed alone.

Build: leaves are numbered by a range partition of (group, identifier), so no group meets in one
task. Blocks of 2^BLOCK neighbouring nodes are hashed to their common ancestor inside one
row, so a tree of any height takes a few rounds. The built levels are stored as node rows:
a row's `node`, its link `up` to an ancestor, and the siblings met on the way. With `hop` = 1 `up` is
the parent; with a larger `hop` it is the ancestor that many levels higher, and rows are
stored for every `hop`-th level only. A group's root links to its leaf in the tree of groups.

Check: a recursive query starts at every leaf's node with the hash to be proved, joins the node row,
adds its siblings to the proof, folds them into the hash and goes on from `up`, until no row is
left. One climb row a leaf and hop is kept; a proof is put together from them at the end.

Defined results: every row is a leaf, with null identifiers first in their group and rows that
repeat an identifier in the order of their leaves (rows that are equal throughout give equal
leaves); a null field is hashed as `-` and an empty text as `0:`; texts of any length are hashed
whole; a null group comes first; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

#: Levels that are hashed inside one row (2^BLOCK nodes of 32 bytes), and levels of one climb step.
BLOCK = 12
HOP = 4
#: A node is level << 48 | place; the levels of the tree of groups begin here.
_LEVEL, _TOP = 48, 64


def encoded(field: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = field.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: Sequence[Column]) -> Column:
    """32 bytes: SHA-256 of the encoded fields in a row."""
    return F.unhex(F.sha2(F.concat(*[encoded(f) for f in fields]), 256))


def numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """`rows`, written in `order`, with their number from 0 as `number`. Rows that are equal in `order`
    are spread over partitions by the place they are read from."""
    placed = rows.withColumn("__place", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange(*order, "__place").sortWithinPartitions(*order, "__place")
    ranged = written(ranged.drop("__place").withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33)
    counts = ranged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return (ranged.withColumn("__part", part).join(offsets, "__part")
            .withColumn("number", F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1))
            .drop("__part", "__before", "__at"))


def _depth(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _node(level, place) -> str:
    return f"(shiftleft(cast({level} as bigint), {_LEVEL}) + {place})"


_PAIR = """unhex(sha2(concat(lower(hex(get(element_at(acc, -1), cast(2 * j as int)))),
                             coalesce(lower(hex(get(element_at(acc, -1), cast(2 * j + 1 as int)))), '')), 256))"""
_LEVELS = f"""aggregate(slice(sequence(1, {BLOCK}), 1, least({BLOCK}, depth - {{base}})), array(hashes),
    (acc, i) -> concat(acc, array(transform(sequence(0, (size(element_at(acc, -1)) - 1) div 2), j -> {_PAIR}))))"""
# the rows of level base + at of one block: siblings at each of the next levels, null where there is none
_ROWS = """transform(levels[{at}], (h, j) -> named_struct('at', j,
    'siblings', transform(sequence({at}, least({at} + {hop}, size(levels) - 1) - 1),
                          l -> get(levels[l], cast(shiftright(j, l - {at}) ^ 1 as int)))))"""


def build_trees(leaves: DataFrame, first_level: int, hop: int) -> tuple[DataFrame, DataFrame]:
    """(node rows, roots) of many trees.

    `leaves`: tree (the number of its first leaf), depth, link (where its root leads, null: nowhere), pos, hash.
    Node rows: node, pos, siblings, up. Roots: tree, hash."""
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    current, rows = leaves, []
    roots = leaves.where("depth = 0").select("tree", "hash")
    for base in range(0, deepest, BLOCK):
        blocks = (current.where(F.col("depth") > base)
                  .groupBy("tree", "depth", "link", F.shiftright("pos", BLOCK).alias("block"))
                  .agg(F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("nodes"))  # 2^BLOCK at most
                  .withColumn("hashes", F.transform("nodes", lambda x: x["hash"]))
                  .withColumn("levels", F.expr(_LEVELS.format(base=base)))
                  .select("tree", "depth", "link", "block", "levels"))
        blocks = written(blocks, "merkle-blocks")
        for at in range(0, BLOCK, hop):
            here = (blocks.where(F.size("levels") > at + 1)
                    .select("tree", "depth", "link", "block", F.inline(F.expr(_ROWS.format(at=at, hop=hop)))))
            pos = f"(shiftleft(block, {BLOCK - at}) + at)"
            over = f"{base + at} + size(siblings)"
            up = f"CASE WHEN {over} < depth THEN {_node(f'({first_level} + {over})', f'tree + shiftright({pos}, size(siblings))')} ELSE link END"
            rows.append(here.selectExpr(f"{_node(first_level + base + at, f'tree + {pos}')} AS node", f"{pos} AS pos",
                                        "siblings", f"{up} AS up"))
        current = blocks.selectExpr("tree", "depth", "link", "block AS pos", "element_at(levels, -1)[0] AS hash")
        roots = roots.unionByName(current.where(F.col("depth") <= base + BLOCK).select("tree", "hash"))
    nodes = rows[0] if rows else leaves.limit(0).selectExpr("pos AS node", "pos", "array(hash) AS siblings", "pos AS up")
    for more in rows[1:]:
        nodes = nodes.unionByName(more)
    return nodes, roots


# climbs from every leaf: folded becomes the hash of the node reached, siblings are those of this step
_CLIMB = """
WITH RECURSIVE climb(leaf, node, step, siblings, folded) AS (
  SELECT number, node, 0, CAST(NULL AS ARRAY<BINARY>), claimed FROM {leaves}
  UNION ALL
  SELECT c.leaf, n.up, c.step + 1, n.siblings,
         aggregate(n.siblings, named_struct('hash', c.folded, 'pos', n.pos), (a, s) -> named_struct(
           'hash', unhex(sha2(concat(CASE WHEN a.pos % 2 = 1 THEN lower(hex(s)) ELSE '' END, lower(hex(a.hash)),
                                     CASE WHEN a.pos % 2 = 0 AND s IS NOT NULL THEN lower(hex(s)) ELSE '' END), 256)),
           'pos', shiftright(a.pos, 1)), a -> a.hash)
  FROM climb c JOIN {nodes} n ON n.node = c.node)
SELECT leaf, step, siblings, folded FROM climb
"""


def climb(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per leaf (number, node, claimed): leaf, folded (32 bytes: the root that follows from the claimed hash)
    and proof (array of the siblings from bottom to top)."""
    spark, limit = leaves.sparkSession, "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # the rows are one a leaf and step
    try:
        steps = written(spark.sql(_CLIMB, leaves=leaves, nodes=nodes), "merkle-climb")
    finally:
        spark.conf.set(limit, before)
    way = F.sort_array(F.collect_list(F.struct("step", F.coalesce("siblings", F.array().cast("array<binary>")).alias("s"))))
    siblings = F.flatten(F.transform(way, lambda x: x["s"]))  # one a level at most
    return steps.groupBy("leaf").agg(F.max_by("folded", "step").alias("folded"),
                                     F.filter(siblings, lambda s: s.isNotNull()).alias("proof"))


def manifest(docs: DataFrame, fields: Sequence[str], id_col: str, group: str, claimed: dict[str, Column] | None = None,
             hop: int = HOP) -> DataFrame:
    """One row a row of `docs`: id_col, leaf, subroot, root, proof (array of hashes), folded_root and
    verified; hashes are 32 bytes.

    `claimed` replaces fields by other values: the proof is then folded from the hash of the row so
    altered, and `verified` says whether that still leads to the root."""
    stated = leaf_hash([F.col(f) for f in fields])
    other = leaf_hash([(claimed or {}).get(f, F.col(f)) for f in fields])
    rows = docs.select(F.col(id_col).alias("id"), F.col(group).alias("grp"), stated.alias("hash"),
                       (other if claimed else stated).alias("claimed"))
    leaves = numbered(written(rows, "merkle-leaves"), ["grp", "id", "hash"], "merkle-ordered")
    groups = leaves.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("tree"))
    groups = numbered(groups, ["grp"], "merkle-groups").withColumn("depth", _depth(F.col("n")))
    groups = written(groups.selectExpr("tree", "depth", f"{_node(_TOP, 'number')} AS link", "number AS place", "grp AS of"),
                     "merkle-trees")
    leaves = (leaves.join(groups.select("tree", "depth", "link", "of"), F.col("grp").eqNullSafe(F.col("of")))
              .withColumn("pos", F.col("number") - F.col("tree")).drop("grp", "of"))
    leaves = written(leaves, "merkle-placed")

    nodes, roots = build_trees(leaves.select("tree", "depth", "link", "pos", "hash"), 0, hop)
    subroots = written(roots.withColumnRenamed("hash", "subroot"), "merkle-roots")
    top = groups.select("tree", "place").join(subroots, "tree")
    depth = max(groups.count() - 1, 0).bit_length()
    top_leaves = top.selectExpr("0L AS tree", f"{depth} AS depth", "CAST(NULL AS BIGINT) AS link", "place AS pos",
                                "subroot AS hash")
    top_nodes, root = build_trees(top_leaves, _TOP, hop)
    nodes = written(nodes.unionByName(top_nodes), "merkle-nodes")

    start = F.when(F.col("depth") > 0, F.col("number")).otherwise(F.col("link")).alias("node")
    found = climb(leaves.select("number", start, "claimed"), nodes)
    summit = root.first()  # one hash, none for an empty table
    out = (leaves.select("id", "number", "tree", F.col("hash").alias("leaf")).join(subroots, "tree")
           .join(found.withColumnRenamed("leaf", "number"), "number")
           .withColumn("root", F.lit(None if summit is None else bytes(summit["hash"])).cast("binary")))
    return out.select(F.col("id").alias(id_col), "leaf", "subroot", "root", "proof", F.col("folded").alias("folded_root"),
                      (F.col("folded") == F.col("root")).alias("verified"))
