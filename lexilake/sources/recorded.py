"""Recorded provider responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilake.functions.text import classify_failure, js_trim
from lexilake.sources.documents import is_string, once, read_documents, strict_json

RECORDS = (
    "struct<records:array<struct<request:struct<sourceLocale:string,sourceText:string,targetLocale:string>,"
    "response:struct<exitCode:int,stdout:string,stderr:string>>>>"
)


def final_message(stdout):
    """Text of the last completed agent message; NULL for none or for a line that is no JSON."""
    lines = F.filter(F.transform(F.split(stdout, "\n"), js_trim), lambda l: l != "")
    events = F.transform(lines, strict_json)

    def last_of(events):
        broken = F.exists(events, lambda e: e.isNull())
        messages = F.filter(events, lambda e: (
            (F.try_variant_get(e, "$.type", "string") == "item.completed")
            & (F.try_variant_get(e, "$.item.type", "string") == "agent_message")
            & is_string(e, "$.item.text")))
        last = F.try_variant_get(F.try_element_at(messages, F.lit(-1)), "$.item.text", "string")
        return F.when(~broken & (last != ""), last)

    # Bound to a variable, as each mention would parse all lines again.
    return F.get(F.transform(F.array(events), last_of), 0)


def parse_recorded_responses(docs: DataFrame, model_version: str = "recorded") -> DataFrame:
    """One row per recorded request, in recording order, with the text or an error code."""
    records = docs.select("project", "path", F.posexplode(F.from_json("text", RECORDS)["records"]).alias("no", "r"))
    ran = records.select(
        "project", "path", F.col("no").cast("bigint").alias("response_no"),
        F.col("r.request.sourceLocale").alias("source_locale"), F.col("r.request.targetLocale").alias("locale"),
        F.col("r.request.sourceText").alias("source_text"), F.col("r.response.exitCode").alias("_exit"),
        classify_failure(F.col("r.response.stderr"), F.col("r.response.stdout")).alias("_failure"),
        final_message(F.col("r.response.stdout")).alias("_message"))
    ran = once(ran, "_payload", strict_json(F.col("_message")))
    payload = F.col("_payload")
    text = F.when(is_string(payload, "$.text"), F.try_variant_get(payload, "$.text", "string"))
    failed = F.col("_exit") != 0
    code = F.when(failed, F.col("_failure.code")).when(text.isNull(), F.lit("L10N_E0055"))
    return ran.select(
        "project", "path", "response_no", "source_locale", "locale", "source_text",
        F.when(~failed, text).alias("text"), F.lit(model_version).alias("model_version"), code.alias("error_code"),
        F.when(failed, F.col("_failure.reason")).alias("reason"))


def read_recorded_responses(spark: SparkSession, path: str, **options) -> DataFrame:
    return parse_recorded_responses(read_documents(spark, path, **options))
