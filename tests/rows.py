"""Small catalogs as tables."""

from lexilake import schemas
from lexilake.functions.hashing import source_hash
from pyspark.sql import functions as F


def source(spark, rows, project=0):
    """rows: (key, text, description, {name: type})."""
    data = [(project, "en", k, t, d, {n: (None, kind) for n, kind in p.items()}, None) for k, t, d, p in rows]
    df = spark.createDataFrame(data, schemas.SOURCE_KEYS)
    return df.withColumn("source_hash", source_hash(F.col("text"), F.col("description"), F.col("placeholders")))


def entries(spark, src, rows, project=0):
    """rows: (locale, key, text, reviewed, fresh)."""
    hashes = {r.key: r.source_hash for r in src.collect()}
    import datetime

    at = datetime.datetime(2024, 1, 1)
    data = [(project, loc, k, t, rev, False, hashes.get(k, "x") if fresh else "sha256:" + "0" * 64, "p", "m", at)
            for loc, k, t, rev, fresh in rows]
    return spark.createDataFrame(data, schemas.ENTRIES)


def locales(spark, names, project=0):
    return spark.createDataFrame([(project, "en", True)] + [(project, n, False) for n in names],
                                 "project int, locale string, is_source boolean")


def rules(spark, case="dotted.lower", depth=4, scopes=(), prefixes=(), project=0):
    return spark.createDataFrame([(project, case, depth, list(scopes), list(prefixes))], schemas.RULES)


def configs(spark, project=0):
    return spark.createDataFrame([(project, "sha256:" + "c" * 64)], "project int, config_hash string")


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def texts(spark, *values):
    """Documents numbered by path."""
    return spark.createDataFrame([(0, str(i), v) for i, v in enumerate(values)], "project int, path string, text string")
