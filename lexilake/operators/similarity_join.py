"""Sets alike by Jaccard similarity, exactly: a join on the rarest elements of each set.

Two sets of sizes m and n that are alike enough share most of their elements.  So if the elements of all sets are put
in one order, rarest first, the two share one among the first ``n - ceil(t * n) + 1`` of each, its prefix.  Sets meet on
the elements of their prefixes, which are in few other sets; their sizes and the places of the element rule out most
of those; the rest are compared in full.  No hashing decides what meets, so nothing is missed.

An element may still be in very many prefixes, as when a passage is copied into a third of all texts.  Its sets first
meet one of them alone, and what links with it is one component; only if several are left are its sets compared in
cells of two blocks, each cell in one task that returns a spanning forest.  No list of pairs of such a group is ever built.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexilake.operators.components import connected_components
from lexilake.session import durable, forget, ship_package, shuffled

#: Sets whose prefixes share an element that are paired as a list; sets of a block of a longer one.
LISTED, BLOCK = 64, 256
#: Elements that a cell compares at a time.
COLUMNS = 8192


def alike(common, a, b, share: tuple[int, int]):
    """Is ``common`` over the union at least ``share[0] / share[1]``?  In whole numbers; columns or arrays."""
    return common * (share[0] + share[1]) >= (a + b) * share[0]


def pairs_alike(sets: list[np.ndarray], share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of all pairs of sets that are alike and share an element."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    _, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = counts[place] > 1
    column = (np.cumsum(counts > 1) - 1)[place[keep]]
    row = np.repeat(np.arange(len(sets)), sizes)[keep]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), dtype=np.int64)
    for low in range(0, int((counts > 1).sum()), COLUMNS):
        a, b = np.searchsorted(column, (low, low + COLUMNS))
        present = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        present[row[a:b], column[a:b] - low] = 1
        common += (present @ present.T).astype(np.int64)
    return np.nonzero(np.triu((common > 0) & alike(common, sizes[:, None], sizes[None, :], share), 1))


def forest(keys: list, i: np.ndarray, j: np.ndarray) -> list[tuple]:
    """Of the links between places i and j those that join two trees, as pairs of keys in order."""
    root = list(range(len(keys)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist()):
        x, y = find(a), find(b)
        if x != y:
            root[y] = x
            out.append((min(keys[a], keys[b]), max(keys[a], keys[b])))
    return out


def prefixes(sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(project, element, key, n, place): the rarest elements of each set, as many as any set like it must meet.

    Elements of one set alone are in no other's prefix; they count, but do not come out.
    """
    n = F.size("elements")
    elements = sets.select("project", "key", n.alias("n"), F.explode("elements").alias("element"))
    counts = elements.groupBy("project", "element").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    # Elements of one set alone come first, so their number gives the places of the others: only those are dealt by key.
    by_key = Window.partitionBy("project", "key").orderBy("c", "element")
    whole = by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    length = F.col("n") - F.floor((F.col("n") * share[0] + (share[1] - 1)) / share[1]).cast("int") + 1
    return elements.join(counts.hint("shuffle_hash"), ["project", "element"]).withColumns({
        "_own": F.count(F.lit(1)).over(whole), "_rank": F.row_number().over(by_key)}).withColumn(
        "place", (F.col("n") - F.col("_own") + F.col("_rank") - 1).cast("int")).filter(F.col("place") < length).select(
        "project", "element", "key", "n", "place")


def _possible(prefix: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The rows of ``prefixes`` that may be the first element an alike pair shares.

    What comes from there on bounds all that two sets share, so the smaller of them holds it early enough to be like a set of
    its own size.  A list without such a set has no pair, and the others of a list must be alike the smallest of these.
    """
    rest, n = F.col("n") - F.col("place"), F.col("n")
    lows = prefix.groupBy("project", "element").agg(F.min(F.when(alike(rest, n, n, share), n)).alias("low")).filter("low IS NOT NULL")
    return prefix.join(shuffled(lows), ["project", "element"]).filter(alike(rest, n, F.col("low"), share)).drop("low")


def _verified(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs (project, a, b) that are alike by their whole sets."""
    left, right = (sets.select("project", F.col("key").alias(k), F.col("elements").alias(f"_{k}")) for k in ("a", "b"))
    both = pairs.join(left, ["project", "a"]).join(right, ["project", "b"])
    common = F.size(F.array_intersect("_a", "_b"))
    return both.filter(alike(common, F.size("_a"), F.size("_b"), share)).select("project", "a", "b")


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of lists that are not within one component."""
    own = members.join(labels, ["project", "key"], "left").withColumn("own", F.coalesce("component", "key"))
    open_lists = own.groupBy("project", "element").agg(F.min("own").alias("low"), F.max("own").alias("high")).filter(
        "low < high").select("project", "element")
    return members.join(open_lists, ["project", "element"])


def _cells(members: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(project, a, b): links that join all that any pairs of a list join."""
    blocks = F.ceil(F.col("m") / BLOCK)
    cells = members.withColumn("own", F.pmod(F.xxhash64("key"), blocks)).select(
        "project", "element", "key", "own", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other")).select(
        "project", "element", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        keys = cell["key"].tolist()
        found = forest(keys, *pairs_alike([np.asarray(e) for e in cell["elements"]], share)) if len(keys) > 1 else []
        project = pd.Series([cell["project"].iloc[0]] * len(found), dtype="int32")
        return pd.DataFrame({"project": project, **{n: pd.Series([f[i] for f in found], dtype=object) for i, n in enumerate("ab")}})

    ship_package(members.sparkSession)
    return cells.join(sets, ["project", "key"]).select("project", "element", "i", "j", "key", "elements").groupBy(
        "project", "element", "i", "j").applyInPandas(compare, "project int, a string, b string")


def alike_components(sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(project, key, component): the smallest key reachable from each key that has a smaller one.

    ``sets`` are (project, key, elements), each key once, elements distinct and not null.  Links are all pairs of a
    project with Jaccard similarity of at least ``share[0] / share[1]`` that share an element.
    """
    prefix = durable(prefixes(sets, share))
    kept = durable(_possible(prefix, share))
    lists = kept.groupBy("project", "element").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    members = durable(kept.join(shuffled(lists), ["project", "element"]))
    short, long = members.filter(F.col("m") <= LISTED), members.filter(F.col("m") > LISTED)
    # Of all that two sets share, what comes after the first shared element bounds the rest.
    other = short.select("project", "element", F.col("key").alias("b"), F.col("n").alias("bn"), F.col("place").alias("bp"))
    bound = F.least(F.col("n") - F.col("place"), F.col("bn") - F.col("bp"))
    listed = short.join(shuffled(other), ["project", "element"]).filter((F.col("key") < F.col("b")) & alike(bound, F.col("n"), F.col("bn"), share))
    hubs = long.groupBy("project", "element").agg(F.min(F.struct("key", "n")).alias("h"))
    stars = long.join(hubs, ["project", "element"]).filter("key > h.key").select(
        "project", F.col("h.key").alias("a"), F.col("key").alias("b"), "n", F.col("h.n").alias("bn")).filter(
        alike(F.least("n", "bn"), F.col("n"), F.col("bn"), share)).select("project", "a", "b")
    pairs = durable(listed.select("project", F.col("key").alias("a"), "b").unionByName(stars).distinct())
    links = durable(_verified(pairs, sets, share))
    labels = connected_components(links)
    left = durable(_mixed(long, labels))
    if not left.isEmpty():
        links = links.unionByName(_cells(left, sets, share))
        labels = connected_components(links)
    forget(prefix, kept, members, pairs, left)
    return labels
