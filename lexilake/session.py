"""Session settings and the durable folder that iterative jobs cut lineage into."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", name: str = "lexilake") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; only where all runs on this machine, as in tests, make one here."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-ckpt-"))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application.

    Only the few operators that run Python in tasks need it; workers that have the package
    installed lose nothing.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="spark-package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it from there on.

    The result no longer depends on how it was computed: a lost executor re-reads it, and
    values that a second run could change (range bounds, partition ids) are settled.  Unlike a
    checkpointed plan it carries no claim about its partitioning, which may be that of a plan
    AQE has since replaced; readers prune its columns and know its size.
    """
    path = shared_path(df.sparkSession, "table")
    # Stored tables are what most disk goes to: a third less than by the default codec.
    df.write.option("compression", "zstd").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def durable_by(df: DataFrame, column: str) -> DataFrame:
    """As ``durable``, in buckets of a column, so that joins on it do not shuffle this table again.

    There are as many buckets as shuffle partitions; a table that comes from a join on the column is in them already.
    """
    spark = df.sparkSession
    path, name = shared_path(spark, "buckets"), f"buckets_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).sortBy(
        column).saveAsTable(name)
    stored = spark.table(name)
    stored._stored_at, stored._stored_as = path, name
    return stored


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    Spark does so when the driver collects garbage, which may be long after the disks are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the catalogs: it is shuffled and merged at every size, never broadcast.

    Spark judges a table by the bytes of its files and the share of its columns that are read.  Compressed files of
    millions of keys stay below its threshold, an ``explode`` counts as one row, and the driver would hold them all.
    """
    return df.hint("merge")


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``durable`` or ``durable_by`` wrote and that no plan reads any more; others are left alone."""
    for table in tables:
        path = getattr(table, "_stored_at", None)
        if path is not None:
            spark = table.sparkSession
            if hasattr(table, "_stored_as"):
                spark.sql(f"DROP TABLE IF EXISTS {table._stored_as}")
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
