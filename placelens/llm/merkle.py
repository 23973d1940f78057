"""Merkle manifest of a table: a hash tree per group of rows, and a tree over the groups' roots.

A parent's children are spread over one column per slot by conditional
aggregates. Hashing the columns together gives the parent; leaving out a child's
own column gives its siblings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelens.llm.common import ROWS_PER_BUCKET, materialise, numbered

# Children of a node.
FANOUT = 3
NO_VALUE = "-"
PATH = "array<struct<before:string,after:string>>"


def digest_of(*texts: Column) -> Column:
    """Lowercase hex SHA-256 of the texts together; nulls are left out."""
    return F.sha2(F.concat_ws("", *texts), 256)


def leaf_digest(*values: Column) -> Column:
    """Digest of a row's values: each as its count of UTF-8 bytes, a colon and itself, or as `-` if it is null."""

    def marked(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit(NO_VALUE))

    return digest_of(*[marked(v) for v in values])


@dataclass(frozen=True)
class Manifest:
    """Stored tables of a manifest.

    `levels` and `top` hold the trees from the leaves upwards, one row per parent:
    tree, idx (its place in its level), n (children in that level of its tree), a
    struct per slot, digest. `groups` has tree, group, rows, subroot and depth, `root` one row
    with the digest (none for an empty table).
    """

    levels: list[DataFrame]
    top: list[DataFrame]
    groups: DataFrame
    root: DataFrame
    fanout: int


def _slots(fanout: int) -> list[str]:
    return [f"slot{k}" for k in range(fanout)]


def _parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """(tree, idx, n, node) to a row per parent; a tree of one node keeps its digest."""
    own = F.pmod("idx", F.lit(fanout))
    slots = [F.max(F.when(own == k, F.col("node"))).alias(name) for k, name in enumerate(_slots(fanout))]
    place = ((F.col("idx") - own) / fanout).cast("bigint").alias("idx")
    rows = nodes.groupBy("tree", place).agg(F.max("n").alias("n"), *slots)
    together = digest_of(*[F.col(name)["digest"] for name in _slots(fanout)])
    return rows.withColumn("digest", F.when(F.col("n") == 1, F.col("slot0.digest")).otherwise(together))


def _grow(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """All levels above the nodes. Each has a `fanout`-th of the rows of the one below, so there are few."""
    levels = [materialise(_parents(nodes, fanout))]
    while True:
        more = levels[-1].filter(F.col("n") > fanout)
        if more.isEmpty():
            return levels
        n = F.ceil(F.col("n") / fanout).cast("bigint").alias("n")
        nodes = more.select("tree", "idx", n, F.struct("digest").alias("node"))
        levels.append(materialise(_parents(nodes, fanout)))


def _ends(levels: list[DataFrame], fanout: int) -> DataFrame:
    """(tree, depth, digest) of the uppermost node of each tree."""
    found = None
    for depth, level in enumerate(levels):
        own = level.filter(F.col("n") <= fanout).select("tree", F.lit(depth).alias("depth"), "digest")
        found = own if found is None else found.unionByName(own)
    return found


def _placed(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves as nodes (tree, idx, n, node), and the stored groups (tree, group, rows), numbered in their order.

    Rows are dealt into ranges of (group, id), numbered within a range, and moved
    on by the rows of earlier ranges, so no task holds more than a range of a group.
    """
    spark = leaves.sparkSession
    stored = materialise(leaves.withColumn("salt", F.monotonically_increasing_id()))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), stored.count() // ROWS_PER_BUCKET + 1)
    order = ["id", "node.digest", "salt"]
    dealt = materialise(stored.repartitionByRange(parts, "key", *order).withColumn("part", F.spark_partition_id()))
    counts = materialise(dealt.groupBy("key", "part").agg(F.first("group").alias("group"), F.count(F.lit(1)).alias("n")))
    groups = counts.groupBy("key").agg(F.first("group").alias("group"), F.sum("n").alias("rows"))
    groups = materialise(numbered(groups, ["key"], "tree"))
    ahead = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("key", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    offsets = offsets.join(groups.select("key", "tree", "rows"), "key")
    inside = F.row_number().over(Window.partitionBy("key", "part").orderBy(*order)) - 1
    nodes = dealt.withColumn("inside", inside).join(offsets, ["key", "part"])
    idx = (F.col("ahead") + F.col("inside")).cast("bigint").alias("idx")
    return nodes.select("tree", idx, F.col("rows").alias("n"), "node"), groups.select("tree", "group", "rows")


def build_manifest(
    docs: DataFrame, id_column: str, group: str, columns: list[str], carry: Column | None = None, fanout: int = FANOUT
) -> Manifest:
    """Trees over all rows: leaves ascend by id within a group, groups ascend by value, a null group first.

    A leaf is the digest of `columns` (see leaf_digest). `carry` comes along to
    the proofs. While a level has several nodes, each run of `fanout` of them
    (the last may be shorter, even one) becomes the digest of the run; what
    remains is the group's subroot, and subroots become the root in the same way.
    Texts are hashed where they lie; only digests, ids and `carry` move.

    Null ids come first in their group, equal ids are ordered by leaf, and equal
    leaves are interchangeable, so repeated rows are leaves of their own. An
    empty table has no groups and no root. Columns that are not named are not
    read, and names may clash with any used here.
    """
    chosen = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("key"),
        F.col(group).alias("group"),
        F.col(id_column).alias("id"),
        F.struct(
            leaf_digest(*[F.col(c) for c in columns]).alias("digest"),
            F.col(id_column).alias("id"),
            (F.lit(None).cast("string") if carry is None else carry).alias("carry"),
        ).alias("node"),
    )
    nodes, groups = _placed(chosen)
    levels = _grow(nodes, fanout)
    ends = _ends(levels, fanout).withColumnRenamed("digest", "subroot")
    groups = materialise(groups.join(ends, "tree"))
    each = groups.select(
        F.lit(0).cast("bigint").alias("tree"),
        F.col("tree").alias("idx"),
        F.lit(groups.count()).cast("bigint").alias("n"),
        F.struct(F.col("subroot").alias("digest")).alias("node"),
    )
    top = _grow(each, fanout)
    root = materialise(_ends(top, fanout).select(F.col("digest").alias("root")))
    return Manifest(levels, top, groups, root, fanout)


def _descend(levels: list[DataFrame], starts: DataFrame, fanout: int, along: list[str]) -> DataFrame:
    """The nodes below `levels` with their paths, from the `starts` (tree, depth, path, along) of all trees.

    A step joins a level to the paths of its nodes and spreads the slots again,
    each with the columns before and after it, so it moves no more than that level's rows.
    """
    names, nodes = _slots(fanout), None
    for depth in reversed(range(len(levels))):
        own = starts.filter(F.col("depth") == depth).select("tree", F.lit(0).cast("bigint").alias("idx"), "path", *along)
        above = own if nodes is None else nodes.select(*own.columns).unionByName(own)
        others = [F.col(name)["digest"] for name in names]

        def child(k: int, name: str, others: list[Column] = others) -> Column:
            before, after = F.concat_ws("", *others[:k]), F.concat_ws("", *others[k + 1 :])
            parts = F.lit(k).alias("k"), F.col(name).alias("node"), before.alias("before"), after.alias("after")
            return F.when(F.col(name).isNotNull(), F.struct(*parts))

        slots = F.explode(F.array_compact(F.array(*[child(k, name) for k, name in enumerate(names)]))).alias("child")
        spread = levels[depth].join(above, ["tree", "idx"]).select("tree", "idx", "n", "path", *along, slots)
        step = F.array(F.struct("child.before", "child.after"))
        nodes = spread.select(
            "tree",
            (F.col("idx") * fanout + F.col("child.k")).alias("idx"),
            F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(step, F.col("path"))).alias("path"),
            "child.node",
            *along,
        )
    return nodes


def proofs(manifest: Manifest) -> DataFrame:
    """One row per leaf: id, carry, leaf, subroot, root, and path, the siblings before and after it, level by level.

    An empty manifest has none.
    """
    none = F.array().cast(PATH)
    start = manifest.root.select(
        F.lit(0).cast("bigint").alias("tree"), F.lit(len(manifest.top) - 1).alias("depth"), none.alias("path"), "root"
    )
    top = _descend(manifest.top, start, manifest.fanout, ["root"])
    starts = top.select(F.col("idx").alias("tree"), "path", "root").join(
        manifest.groups.select("tree", "depth", "subroot"), "tree"
    )
    along = ["subroot", "root"]
    found = _descend(manifest.levels, materialise(starts), manifest.fanout, along)
    return found.select("node.id", "node.carry", F.col("node.digest").alias("leaf"), *along, "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to with the siblings of `path`."""
    return F.aggregate(path, leaf, lambda digest, step: digest_of(step["before"], digest, step["after"]))


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")
