"""Source copy that exists under several keys: exact groups and reviewed near groups.

Groups are kept long, one row per member: a text shared by a third of all keys is then many
rows, never one row holding them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexilake.diagnostics import diagnose
from lexilake.functions.hashing import set_fingerprint
from lexilake.functions.text import js_trim
from lexilake.session import shuffled


def exact_duplicates(source: DataFrame) -> DataFrame:
    """Members of every text used by more than one key: canonical key is the smallest.

    Texts are compared by SHA-256, so only hashes and keys are shuffled.
    """
    hashed = source.select("project", "key", F.sha2("text", 256).alias("text_hash"))
    groups = hashed.groupBy("project", "text_hash").agg(
        F.min("key").alias("canonical_key"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return hashed.join(shuffled(groups), ["project", "text_hash"]).select(
        "project", "text_hash", "key", "canonical_key", "n")


def exact_findings(members: DataFrame) -> DataFrame:
    """One warning per duplicate key, naming the key to reuse."""
    extra = members.filter(F.col("key") != F.col("canonical_key"))
    return diagnose(extra, "L10N_E0070", {"canonical_key": F.col("canonical_key")})


def normalize_dup_groups(groups: DataFrame, source: DataFrame, exact: DataFrame) -> DataFrame:
    """Clean suggested groups: known keys only, nothing that is an exact group, each set once.

    ``groups`` has project, group_id, canonical_key, duplicate_key, confidence, rationale and
    model_version, a row per duplicate.  Of groups with the same keys the last one stays.
    """
    keys = source.select("project", "key")
    known = groups.filter(F.col("canonical_key") != F.col("duplicate_key")).join(
        shuffled(keys.withColumnRenamed("key", "canonical_key")), ["project", "canonical_key"], "left_semi").join(
        shuffled(keys.withColumnRenamed("key", "duplicate_key")), ["project", "duplicate_key"], "left_semi").dropDuplicates(
        ["project", "group_id", "canonical_key", "duplicate_key"])
    heads = known.select("project", "group_id", F.col("canonical_key").alias("key")).distinct()
    members = heads.unionByName(known.select("project", "group_id", F.col("duplicate_key").alias("key")))
    belongs = members.join(shuffled(exact.select("project", "key", "text_hash")), ["project", "key"], "left")
    judged = belongs.groupBy("project", "group_id").agg(
        set_fingerprint(F.sha2("key", 256)).alias("_set"),
        F.min("text_hash").alias("_low"), F.max("text_hash").alias("_high"),
        F.count("text_hash").alias("_exact"), F.count(F.lit(1)).alias("_all"))
    one_exact_group = (F.col("_exact") == F.col("_all")) & (F.col("_low") == F.col("_high"))
    last = judged.filter(~one_exact_group).groupBy("project", "_set").agg(F.max("group_id").alias("group_id"))
    return known.join(shuffled(last.select("project", "group_id")), ["project", "group_id"]).select(
        "project", "group_id", "canonical_key", "duplicate_key",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))).alias("confidence"),
        js_trim(F.col("rationale")).alias("rationale"), "model_version")


def semantic_findings(groups: DataFrame) -> DataFrame:
    return diagnose(groups.withColumn("key", F.col("duplicate_key")), "L10N_E0071", {
        "canonical_key": F.col("canonical_key"), "confidence": F.round("confidence", 2),
        "model_version": F.col("model_version")})


def dedupe_summary(exact: DataFrame, groups: DataFrame, source: DataFrame) -> DataFrame:
    """Group and key counts per project."""
    e = exact.groupBy("project").agg(
        F.count_if(F.col("key") == F.col("canonical_key")).alias("exact_groups"),
        F.count(F.lit(1)).alias("_exact_keys"))
    per_group = groups.groupBy("project", "group_id").agg((F.count(F.lit(1)) + 1).alias("_keys"))
    g = per_group.groupBy("project").agg(
        F.count(F.lit(1)).alias("semantic_groups"), F.sum("_keys").alias("_group_keys"))
    keys = source.groupBy("project").agg(F.count(F.lit(1)).alias("source_keys"))
    zero = F.lit(0)
    return keys.join(e, "project", "left").join(g, "project", "left").select(
        "project", "source_keys",
        F.coalesce("exact_groups", zero).alias("exact_groups"),
        F.coalesce("semantic_groups", zero).alias("semantic_groups"),
        (F.coalesce("_exact_keys", zero) + F.coalesce("_group_keys", zero)).alias("duplicate_keys"))
