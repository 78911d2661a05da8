"""Connected components of links inside projects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexilake.session import durable, forget


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest key reachable from each key; ``edges`` has project, a and b with a < b.

    Alternates large-star and small-star until nothing changes.  Each step is a grouped minimum,
    which combines map-side, and a join back, which may be split where a star is large.
    """
    edges = durable(edges.select("project", "a", "b").distinct())
    previous = None
    while True:
        both = edges.unionByName(edges.select("project", F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("project", "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(low, ["project", "a"]).select(
            "project", F.col("m").alias("a"), "b").filter(F.col("a") < F.col("b")).distinct()
        down = large.groupBy("project", "b").agg(F.min("a").alias("m"))
        small = large.join(down, ["project", "b"]).select(
            "project", F.col("m").alias("_m"), F.col("a").alias("_a"), "b")
        linked = small.select("project", F.col("_m").alias("a"), "b").unionByName(
            small.select("project", F.col("_m").alias("a"), F.col("_a").alias("b")))
        before, edges = edges, durable(linked.filter(F.col("a") < F.col("b")).distinct())
        forget(before)
        state = edges.agg(F.count(F.lit(1)),
                          F.sum(F.xxhash64("project", "a", "b").cast("decimal(38,0)"))).first()
        if state == previous:
            return edges.select("project", F.col("b").alias("key"), F.col("a").alias("component"))
        previous = state
