"""Snapshots of managed files that store each content once.

A snapshot is a manifest: a row per path with the hash of its content, null where there was no file.  Contents are
blobs, a table of hash and content that all snapshots of all projects share, in folders by the first digits of the
hash.  Writing a snapshot adds the blobs that are not there yet and then its manifest, so one that was interrupted is
not seen, and a repeated one replaces its manifest and adds nothing.  What changed between two snapshots is a join of
two manifests, and a restore reads no content but that of the files it writes.

Snapshots of a folder are written one at a time, as the history they belong to is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilake.session import durable, forget, shuffled

BLOBS, MANIFESTS = "blobs", "manifests"
MANIFEST_SCHEMA = "project int, path string, hash string, bytes bigint, history_id string"
BLOB_SCHEMA = "hash string, content string, prefix string"


def content_hash(content: str = "content") -> F.Column:
    """The hash of a text; null where there is none."""
    return F.sha2(F.col(content).cast("binary"), 256)


def _table(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of a folder, none where nothing was written."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(history_id, project, path, hash, bytes) of every snapshot; filters on the id read its folder alone."""
    return _table(spark, f"{path}/{MANIFESTS}", MANIFEST_SCHEMA)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, f"{path}/{BLOBS}", BLOB_SCHEMA)


def write_snapshot(files: DataFrame, path: str) -> None:
    """Store snapshots (history_id, project, path, content), each path once for each id.

    Of equal contents one is kept before any is moved; only contents whose hash is not known are written.
    """
    spark = files.sparkSession
    # Both tables are written from the same rows; what makes the files runs once.
    hashed = durable(files.withColumn("hash", content_hash()))
    known = read_blobs(spark, path).select("hash").distinct()
    fresh = hashed.filter("hash IS NOT NULL").select("hash", "content").dropDuplicates(["hash"]).join(shuffled(known), "hash", "left_anti")
    # The blobs are read while more are added, so what to add is settled first.
    stored = durable(fresh.withColumn("prefix", F.substring("hash", 1, 2)))
    stored.select("hash", "content", "prefix").write.mode("append").partitionBy("prefix").parquet(f"{path}/{BLOBS}")
    forget(stored)
    hashed.select("project", "path", "hash", F.octet_length("content").cast("bigint").alias("bytes"), "history_id").write.mode(
        "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("history_id").parquet(f"{path}/{MANIFESTS}")
    forget(hashed)


def contents(manifest: DataFrame, blobs: DataFrame) -> DataFrame:
    """The rows of a manifest with their contents; rows without a file keep none."""
    return manifest.join(shuffled(blobs.select("hash", "content")), "hash", "left")


def read_snapshot(spark: SparkSession, path: str, history_id: str) -> DataFrame:
    """(history_id, project, path, content) of one snapshot."""
    manifest = read_manifests(spark, path).filter(F.col("history_id") == history_id)
    return contents(manifest, read_blobs(spark, path)).select("history_id", "project", "path", "content")


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(project, path, before_hash, after_hash) of the paths whose content differs; both are (project, path, hash)."""
    old = before.select("project", "path", F.col("hash").alias("before_hash"))
    new = after.select("project", "path", F.col("hash").alias("after_hash"))
    return old.join(new, ["project", "path"], "full_outer").filter(~F.col("before_hash").eqNullSafe(F.col("after_hash")))


def restore_plan(spark: SparkSession, path: str, history_id: str, current: DataFrame) -> DataFrame:
    """(project, path, action, content): what brings the files of a snapshot back, and no row for what is as it was.

    ``current`` is (project, path, content), or (project, path, hash) of files that are hashed already.  Paths that
    the snapshot does not name are left alone.  A path without a file then is deleted now.
    """
    now = current if "hash" in current.columns else current.select("project", "path", content_hash().alias("hash"))
    wanted = read_manifests(spark, path).filter(F.col("history_id") == history_id)
    changed = wanted.join(shuffled(now.select("project", "path", F.col("hash").alias("_now"))), ["project", "path"], "left").filter(
        ~F.col("hash").eqNullSafe(F.col("_now")))
    return contents(changed, read_blobs(spark, path)).select(
        "project", "path", F.when(F.col("hash").isNull(), "delete").otherwise("write").alias("action"), "content")
