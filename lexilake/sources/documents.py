"""Whole text files as (project, path, text), and small JSON shape tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilake.session import durable


def read_documents(spark: SparkSession, path: str, glob: str | None = None,
                   project_pattern: str | None = None) -> DataFrame:
    """One row per file below ``path``.  ``project_pattern`` captures the project id in the path."""
    take_repeated_members(spark)
    files = spark.read.text(
        path, wholetext=True, recursiveFileLookup=True, **({"pathGlobFilter": glob} if glob else {}),
    ).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    project = F.regexp_extract("path", project_pattern, 1).cast("int") if project_pattern else F.lit(0)
    return files.select(project.alias("project"), "path", "text")


def take_repeated_members(spark: SparkSession) -> None:
    """Let a member name that a JSON document repeats count with its last value.

    Spark has this for a session only, and takes no such document without it; all that parses documents asks for it.
    """
    setting = "spark.sql.variant.allowDuplicateKeys"
    if spark.conf.get(setting) != "true":
        spark.conf.set(setting, "true")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column so that it is computed once per row.

    Filters on a plain column are rewritten in terms of its definition and pushed down, which
    repeats the definition at every mention.  A generated column stays a value.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def judged_once(judged: DataFrame, **values: Column) -> DataFrame:
    """Documents judged as variants (``text``, ``v``), stored with what is taken from them instead.

    Rows and findings both come from the stored table, so no document is parsed twice.
    """
    return durable(judged.withColumns(values).drop("text", "v"))


# Closes the wrapping array of strict_json; a document cannot fake it by chance.
_END = '"lexilake:end"'


def _wrapped(text: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(f",{_END}]")))


def _unwrapped(wrapped: Column) -> Column:
    whole = (F.try_variant_get(wrapped, "$[1]", "string") == _END.strip('"')) & F.try_variant_get(
        wrapped, "$[2]", "variant").isNull()
    return F.when(whole, F.try_variant_get(wrapped, "$[0]", "variant"))


def strict_json(text: Column) -> Column:
    """The document as a variant, NULL unless the whole text is exactly one JSON value.

    The parser stops after the first value and ignores what follows, so the text is parsed as
    the first of two array elements, of which the second must come out right.  It is bound to the
    variable of a lambda, as generators and lambdas would parse it again at every mention.
    """
    return F.get(F.transform(F.array(_wrapped(text)), _unwrapped), 0)


def parse_once(df: DataFrame, name: str, text: Column) -> DataFrame:
    """Add :func:`strict_json` of ``text``, by generated columns; the quickest way for a column of documents."""
    return once(once(df, "_wrapped", _wrapped(text)), name, _unwrapped(F.col("_wrapped"))).drop("_wrapped")


def json_type(v: Column, path: str = "$") -> Column:
    """STRING, BOOLEAN, OBJECT…, ARRAY…, a number type, VOID for null; SQL NULL when absent."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def is_string(v: Column, path: str = "$") -> Column:
    return F.coalesce(json_type(v, path) == "STRING", F.lit(False))


def is_object(v: Column, path: str = "$") -> Column:
    return F.coalesce(json_type(v, path).startswith("OBJECT"), F.lit(False))


def is_integer(v: Column, path: str = "$") -> Column:
    number = F.try_variant_get(v, path, "double")
    kind = json_type(v, path)
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.coalesce(numeric & (number == F.floor(number)), F.lit(False))


def is_absent(v: Column, path: str) -> Column:
    return json_type(v, path).isNull()


def members(v: Column, path: str) -> Column:
    """The object at ``path`` as map<string, variant>."""
    return F.try_variant_get(v, path, "map<string,variant>")


def all_values(m: Column, test) -> Column:
    return F.forall(F.map_values(m), test)
