"""A training corpus from ``documents``: quality, toxicity, near-duplicates, packing.

Each stage takes what its predecessor kept, with the columns of ``documents``; a stage's table is written and
read again before the next.  The last returns the packed pieces.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilake.llm import minhash, packing, quality, toxicity
from lexilake.llm.shared import table
from lexilake.session import durable

#: A document stays if it is good with at least this probability, and if it is toxic with less than this.
LEAST_GOOD = 0.3
LEAST_TOXIC = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the line chain does not reject."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_documents(docs, model, LEAST_GOOD)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without significant toxic passages."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_documents(docs, model, LEAST_TOXIC)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id.

    A row is a document: of rows that share an id, and of rows without one, each counts for itself, so copies among
    them go too and unlike texts stay; a row with an id goes before one without.  Texts without words are like nothing
    and all stay.  Ids that tell the rows apart are used as they are; else rows are numbered in order of id first.
    """
    if docs.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty():
        kept = durable(minhash.near_duplicates(docs).filter("kept").select("doc_id"))
        # The same plan at every size.
        return docs.join(kept.hint("merge"), "doc_id", "left_semi").select(*docs.columns)
    order = [F.asc_nulls_last("r.doc_id"), F.asc("r.text")]
    rows = durable(docs.select(F.struct("*").alias("r")).repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "at", F.monotonically_increasing_id()))
    kept = durable(minhash.near_duplicates(rows.select("at", F.col("r.text").alias("text")), key="at").filter("kept").select("at"))
    return rows.join(kept.hint("merge"), "at", "left_semi").select("r.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document's tokens, packed into sequences."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("minhash_near_duplicates", near_duplicates_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can neither train the classifiers nor run the tokenizer; tests/llm checks each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each stored before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
