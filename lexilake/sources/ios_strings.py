"""``"key" = "value";`` resources: one small scanner per file, inside the tasks that read them."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilake.diagnostics import diagnose
from lexilake.functions.keys import reverse_key
from lexilake.functions.text import unique_placeholders
from lexilake.schemas import PLACEHOLDERS
from lexilake.session import ship_package
from lexilake.sources.documents import read_documents

# What may stand between tokens, and the tokens of one pair.
_TRIVIA = r"(?:\s++|//[^\n]*(?:\n|\Z)|/\*[\s\S]*?(?:\*/|\Z))*+"
_QUOTED = r'"((?:[^"\\]|\\[\s\S])*)"'
_PAIR = re.compile(f"{_TRIVIA}{_QUOTED}{_TRIVIA}={_TRIVIA}{_QUOTED}{_TRIVIA};")
_REST = re.compile(f"{_TRIVIA}\\Z")


def _pairs(text: str) -> list[tuple[str, str]] | None:
    """Pairs of a file, the last of equal keys only; None when anything is malformed."""
    found, at = {}, 0
    while not _REST.match(text, at):
        pair = _PAIR.match(text, at)
        if pair is None:
            return None
        try:
            key, value = (json.loads(f'"{part}"') for part in pair.groups())
        except ValueError:
            return None
        found[key], at = value, pair.end()
    return list(found.items())


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf = pdf.assign(pairs=[_pairs(text) for text in pdf["text"]])
        yield pdf.assign(good=pdf["pairs"].notna(), pairs=[
            [{"k": k, "v": v} for k, v in pairs] if pairs is not None else [] for pairs in pdf["pairs"]
        ]).drop(columns="text")


def parse_ios_strings(docs: DataFrame, source_locale: str = "en",
                      key_transform: str = "identity") -> tuple[DataFrame, DataFrame]:
    """Platform entries of every file; all placeholders are of type string in this format."""
    if "locale" not in docs.columns:
        folder = F.regexp_extract("path", r"([^/]*)\.lproj/[^/]*\z", 1)
        docs = docs.withColumn("locale", F.coalesce(F.nullif(folder, F.lit("")), F.lit(source_locale)))
    ship_package(docs.sparkSession)
    scanned = docs.select("project", "path", "locale", "text").mapInPandas(
        _scan, "project int, path string, locale string, pairs array<struct<k:string,v:string>>, good boolean")
    none = F.create_map().cast(PLACEHOLDERS)
    rows = scanned.filter("good").select("project", "locale", F.explode("pairs").alias("p")).select(
        "project", F.lit("ios").alias("platform"), "locale", reverse_key(F.col("p.k"), key_transform).alias("key"),
        F.col("p.v").alias("text"), F.lit(None).cast("string").alias("comment"),
        unique_placeholders(F.col("p.v"), none).alias("placeholders"))
    return rows, diagnose(scanned.filter(~F.col("good")), "L10N_E0031")


def ingest_ios_strings(spark: SparkSession, path: str, source_locale: str = "en",
                       key_transform: str = "identity", **options) -> tuple[DataFrame, DataFrame]:
    return parse_ios_strings(read_documents(spark, path, **options), source_locale, key_transform)
