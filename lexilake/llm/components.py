"""Connected components of links by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexilake.session import durable


def components(links: DataFrame) -> DataFrame:
    """(key, component): the smallest key reachable from each key that has a smaller one; links are (a, b), a < b.

    A round first moves each link from its smaller end to that end's smallest neighbour: minima are combined in
    tasks, and the join that brings them back may be split where an end has very many links.  Then the larger
    end's other links go to its smallest.  Rounds end when no key has two links or stands at both ends.
    """
    links = links.select("a", "b").filter("a < b")
    while True:
        low = links.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "a")
        up = links.join(low, "a", "left").select(F.coalesce("m", "a").alias("a"), "b")
        least = up.withColumn("m", F.min("a").over(Window.partitionBy("b")))
        # A row whose smaller end is the smallest gives one link, any other two.
        ends = F.when(F.col("a") == F.col("m"), F.array("b")).otherwise(F.array("a", "b"))
        links = durable(least.select(F.col("m").alias("a"), F.explode(ends).alias("b")).distinct())
        places = links.select(F.explode(F.array(
            F.struct(F.col("a").alias("k"), F.lit(True).alias("low"), F.lit(0).alias("n")),
            F.struct(F.col("b").alias("k"), F.lit(False).alias("low"), F.lit(1).alias("n")))).alias("p")).select("p.*")
        if places.groupBy("k").agg(F.max("low").alias("low"), F.sum("n").alias("n")).filter("n > 1 OR (low AND n > 0)").isEmpty():
            return links.select(F.col("b").alias("key"), F.col("a").alias("component"))
