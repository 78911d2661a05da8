"""Near-duplicate source copy: the measured stand-in for a model's semantic suggestions.

Exact copies collapse first.  The rest are compared as sets of word triples, by the exact join of
``similarity_join``: every pair at least as alike as the threshold links its keys, and keys that links
join form a group.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexilake.operators.components import connected_components
from lexilake.operators.similarity_join import alike_components
from lexilake.session import durable, shuffled
from lexilake.sources.documents import once

__all__ = ["connected_components", "jaccard", "near_duplicates", "shingles", "words_of"]

SHINGLE_WORDS = 3


def words_of(text) -> F.Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words) -> F.Column:
    """Distinct hashes of word triples; shorter texts are one shingle."""
    n = F.greatest(F.size(words) - (SHINGLE_WORDS - 1), F.lit(0))
    triples = F.transform(
        F.arrays_zip(*[F.slice(words, 1 + i, n).alias(f"w{i}") for i in range(SHINGLE_WORDS)]),
        lambda s: F.xxhash64(*[s[f"w{i}"] for i in range(SHINGLE_WORDS)]))
    return F.when(n > 0, F.array_distinct(triples)).otherwise(
        F.array(F.xxhash64(F.array_join(words, " "))))


def jaccard(a, b) -> F.Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def near_duplicates(source: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Members of near-duplicate groups: canonical key, duplicate key and the group's confidence.

    The canonical key is the smallest of its group.  Confidence is the similarity of its text with that of the member
    that is least like it.  Every key of a collapsed exact copy is listed; groups of exact copies alone are not near
    groups.
    """
    share = Fraction(str(threshold)).limit_denominator(1000)
    # Hashes and keys alone find the first of each set of copies; only its text moves.
    hashed = durable(source.select("project", "key", F.sha2("text", 256).alias("text_hash")))
    firsts = hashed.groupBy("project", "text_hash").agg(F.min("key").alias("key"))
    texts = source.select("project", "key", "text").join(shuffled(firsts), ["project", "key"])
    docs = durable(once(texts, "_words", words_of(F.col("text"))).select(
        "project", "text_hash", "key", shingles(F.col("_words")).alias("elements")))
    components = alike_components(docs.drop("text_hash"), (share.numerator, share.denominator))
    roots = components.select("project", F.col("component").alias("key"), "component").distinct()
    labelled = durable(components.unionByName(roots))
    first = docs.select("project", F.col("key").alias("component"), F.col("elements").alias("_first"))
    confidence = components.join(shuffled(docs.drop("text_hash")), ["project", "key"]).join(shuffled(first), ["project", "component"]).groupBy(
        "project", "component").agg(F.min(jaccard(F.col("elements"), F.col("_first"))).alias("confidence"))
    copies = hashed.select("project", "text_hash", F.col("key").alias("duplicate_key"))
    grouped = labelled.join(shuffled(docs.select("project", "key", "text_hash")), ["project", "key"]).select(
        "project", "component", "text_hash")
    return grouped.join(shuffled(copies), ["project", "text_hash"]).join(shuffled(confidence), ["project", "component"]).filter(
        F.col("duplicate_key") != F.col("component")).select(
        "project", F.col("component").alias("canonical_key"), "duplicate_key", "confidence")
