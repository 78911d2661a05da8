"""The translation cache: upsert and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexilake.schemas import CACHE_KEY
from lexilake.session import shuffled


def upsert_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace the rows of the same key; the rest stay."""
    return cache.join(shuffled(new.select(*CACHE_KEY)), CACHE_KEY, "left_anti").unionByName(new.select(cache.columns))


def gc_cache(cache: DataFrame, source: DataFrame, keep: int = 2) -> DataFrame:
    """Drop rows of dead source hashes, then keep the newest ``keep`` per hash, locale and config.

    Spark turns a rank filter this small into a per-task group limit ahead of the shuffle, so
    even a group holding a third of the cache sends ``keep`` rows per task.
    """
    live = cache.join(shuffled(source.select("project", "source_hash")), ["project", "source_hash"], "left_semi")
    newest = Window.partitionBy("project", "source_hash", "locale", "config_hash").orderBy(
        F.desc("cached_at"), F.desc("model_version"), F.desc("text"))
    return live.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= keep).drop("_rn")
