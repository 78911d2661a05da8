"""Places where the user's own function runs, and the formats that can be plugged in."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexilake.functions.keys import restyle_key
from lexilake.session import durable, ship_package, shuffled
from lexilake.sinks import platforms as sink
from lexilake.sources.android import ingest_android_strings
from lexilake.sources.ios_strings import ingest_ios_strings
from lexilake.sources.xcstrings import ingest_xcstrings

RESPONSES = "request_id string, response_no bigint, text string, model_version string, error_code string"
# What tells one task from another; all other columns of a request are what the provider is asked.
TASK = ("project", "key", "source_hash")


def translate_with(requests: DataFrame, fn: Callable[[dict], tuple[str, str]]) -> DataFrame:
    """Call ``fn`` once per distinct request and give its answer to every task that asks it.

    Requests are distinct if anything the provider is asked differs: text, locales, description, placeholders
    or glossary.  ``fn`` gets the request as a dict and returns (text, model version).  An exception becomes
    a row with an error code and the other rows go on; ``error_code`` is the exception's own ``code``
    attribute where it has one.  The result has the task's columns and the answer's.
    """
    asked = [c for c in requests.columns if c not in TASK]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for request in pdf.to_dict("records"):
                request_id = request.pop("request_id")
                try:
                    text, model, code = *fn(request), None
                except Exception as failure:  # noqa: BLE001
                    text, model, code = None, None, getattr(failure, "code", "L10N_E0054")
                rows.append((request_id, 0, text, model, code))
            yield pd.DataFrame(rows, columns=["request_id", "response_no", "text", "model_version", "error_code"])

    ship_package(requests.sparkSession)
    content = F.to_json(F.struct(*asked), {"ignoreNullFields": "false"})
    tasks = durable(requests.withColumn("request_id", F.sha2(content, 256)))
    # The provider is asked once even if its rows are read again.
    answers = durable(tasks.select("request_id", *asked).dropDuplicates(["request_id"]).mapInPandas(run, RESPONSES))
    named = [c for c in ("project", "locale", "key", "source_locale", "source_text") if c in requests.columns]
    return tasks.select(*named, "request_id").join(shuffled(answers), "request_id").drop("request_id")


PLAN = "project int, from_key string, to_key string, rationale string, skip_reason string"


def plan_renames_with(batches: DataFrame, fn: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """Call ``fn`` once per batch of candidates; batches are bounded by their numbering."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        project, known = int(pdf["project"].iloc[0]), set(pdf["key"])
        plans = fn(pdf[["key", "text", "description", "violations"]].to_dict("records"))
        clean = lambda value: (value or "").strip() or None
        rows = [(project, p["from"], clean(p.get("to")), clean(p.get("rationale")), clean(p.get("skip_reason")))
                for p in plans if p.get("from") in known]
        return pd.DataFrame(rows, columns=["project", "from_key", "to_key", "rationale", "skip_reason"])

    ship_package(batches.sparkSession)
    return batches.groupBy("project", "batch_id").applyInPandas(run, PLAN)


def plan_renames(candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """The deterministic default plan: restyle the key, drop a forbidden prefix, cut to the depth."""
    separator = F.when(F.col("key_case") == "dotted.lower", ".").when(F.col("key_case") == "kebab", "-").otherwise("_")
    prefix = F.get(F.filter("forbidden_prefixes", lambda p: (p != "") & F.startswith(F.col("key"), p)), 0)
    trimmed = F.when(prefix.isNotNull(), F.substring(F.col("key"), F.length(prefix) + 1, F.length("key"))).otherwise(
        F.col("key"))
    styled = restyle_key(trimmed, F.col("key_case"))
    depth = F.col("max_depth")
    # A key too deep keeps its first segments and its last, which tells it from its siblings.
    words = F.call_function("split", styled, F.when(separator == ".", F.lit(r"\.")).otherwise(separator))
    cut = F.when(F.size(words) <= depth, words).when(depth == 1, F.array(F.array_join(words, ""))).otherwise(
        F.concat(F.slice(words, F.lit(1), depth - 1), F.array(F.element_at(words, -1))))
    to = F.array_join(cut, "\u0000")
    joined = F.call_function("replace", to, F.lit("\u0000"), separator)
    return candidates.join(rules, "project").select(
        "project", F.col("key").alias("from_key"),
        F.when((joined != "") & (joined != F.col("key")), joined).alias("to_key"),
        F.lit("restyled").alias("rationale"),
        F.when((joined == "") | (joined == F.col("key")), F.lit("no other spelling")).alias("skip_reason"))


@dataclass(frozen=True)
class PlatformFormat:
    """The two jobs a resource format needs."""

    ingest: Callable
    export: Callable


PLATFORM_FORMATS = {
    "android": PlatformFormat(ingest_android_strings, sink.export_android),
    "ios_strings": PlatformFormat(ingest_ios_strings, sink.export_ios_strings),
    "ios_xcstrings": PlatformFormat(ingest_xcstrings, sink.export_xcstrings),
}
