"""Hash trees over keyed rows, so that two catalogs are compared by what differs in them.

A key's place is the first digits of its own hash, so a tree has the same shape whatever the keys are called, and a
leaf holds about as many keys as any other.  A leaf's digest is of its sorted keys and content hashes, a node's of
its children's.  Equal digests mean equal rows.  Two trees are compared from the root down, each level only below the
nodes that differ, and rows only below the leaves that do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexilake.session import durable

#: Leaves hold about this many keys; a node has 16 children.
LEAF_KEYS = 512


def tree_depth(keys: int) -> int:
    """The levels below the root at which leaves hold about ``LEAF_KEYS`` of that many keys."""
    depth = 1
    while keys > LEAF_KEYS * 16 ** depth:
        depth += 1
    return depth


def place(depth: int) -> F.Column:
    return F.substring(F.sha2(F.col("key").cast("binary"), 256), 1, depth)


def hash_tree(rows: DataFrame, depth: int, content: str = "source_hash") -> DataFrame:
    """(project, level, node, digest, n) for every node that holds keys; level 0 is the root, with node ''.

    ``rows`` have project, key and a content hash, each key once.  The keys of a leaf come together in one row, a
    bounded number with the depth that ``tree_depth`` gives.
    """
    leaf = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", content))), lambda r: F.concat_ws(
        "\u001f", r["key"], r[content])), "\u001e")
    level = durable(rows.groupBy("project", place(depth).alias("node")).agg(
        F.sha2(leaf.cast("binary"), 256).alias("digest"), F.count(F.lit(1)).alias("n")))
    out = level.withColumn("level", F.lit(depth))
    for d in range(depth - 1, -1, -1):
        children = F.array_sort(F.collect_list(F.struct("node", "digest")))
        level = level.groupBy("project", F.substring("node", 1, d).alias("node")).agg(
            F.sha2(F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["node"], c["digest"])), ",").cast("binary"), 256).alias("digest"),
            F.sum("n").alias("n"))
        out = out.unionByName(level.withColumn("level", F.lit(d)))
    return out.select("project", "level", "node", "digest", "n")


def differing_leaves(a: DataFrame, b: DataFrame) -> DataFrame:
    """(project, node): the leaves of two trees of one depth whose digests differ, found from the root down."""
    a, b = durable(a), durable(b)
    depth = a.unionByName(b).agg(F.max("level")).first()[0] or 0
    open_nodes = None
    for d in range(depth + 1):
        sides = [t.filter(F.col("level") == d).select("project", "node", F.col("digest").alias(name)) for t, name in ((a, "x"), (b, "y"))]
        if open_nodes is not None:
            parents = open_nodes.select("project", F.col("node").alias("parent"))
            sides = [s.withColumn("parent", F.substring("node", 1, d - 1)).join(parents, ["project", "parent"], "left_semi").drop("parent")
                     for s in sides]
        open_nodes = durable(sides[0].join(sides[1], ["project", "node"], "full_outer").filter(
            ~F.col("x").eqNullSafe(F.col("y"))).select("project", "node"))
    return open_nodes


def changed_keys(before: DataFrame, after: DataFrame, depth: int | None = None, content: str = "source_hash") -> DataFrame:
    """(project, key, change): keys added, removed or changed between two sets of rows.

    Only the keys of leaves that differ are joined.
    """
    if depth is None:
        depth = tree_depth(before.groupBy("project").count().agg(F.max("count")).first()[0] or 0)
    leaves = differing_leaves(hash_tree(before, depth, content), hash_tree(after, depth, content))
    near = lambda rows, name: rows.withColumn("node", place(depth)).join(leaves, ["project", "node"], "left_semi").select(
        "project", "key", F.col(content).alias(name))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    return near(before, "_old").join(near(after, "_new"), ["project", "key"], "full_outer").filter(
        ~F.col("_old").eqNullSafe(F.col("_new"))).select("project", "key", change.alias("change"))
